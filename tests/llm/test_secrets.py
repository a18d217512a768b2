import collections
import hashlib
import math
import random
import re

from marginalia.llm import secrets

ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
D, L = "0123456789", "abcdefghijklmnopqrstuvwxyz"
U = L.upper()
ALPHABETS = [("hex", D + "abcdef"), ("HEX", D + "ABCDEF"), ("base32", U + "234567"), ("base36", D + L), ("BASE36", D + U), ("base62", U + L + D), ("base64", U + L + D + "+/"), ("base64url", U + L + D + "-_")]


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    return out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]


def tail(z):
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token):
    """Stratum and structured p-value of a run that the tests do not reject, else None."""
    name, alphabet = next(((a, b) for a, b in ALPHABETS if set(token) <= set(b)), (None, ""))
    if name is None:
        return None
    n, k = len(token), len(alphabet)
    v = [alphabet.index(c) for c in token]
    squares = sum(c * c for c in collections.Counter(token).values())
    chi, df = k / n * squares - n, k - 1
    fit = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    up = lambda z: tail(z) / 2 if z >= 0 else 1 - tail(z) / 2
    high = [x >= k // 2 for x in v]
    both = 2 * sum(high) * (n - sum(high))
    turns = 1 + sum(a != b for a, b in zip(high, high[1:]))
    spread = both * (both - n) / (n * n * (n - 1))
    runs = tail((turns - both / n - 1) / math.sqrt(spread)) if spread > 0 else 0
    level = n * sum(x * x for x in v) - sum(v) ** 2
    lag = sum(a * b for a, b in zip(v, v[1:] + v[:1]))
    serial = tail(((n * lag - sum(v) ** 2) / level + 1 / (n - 1)) * (n - 1) / math.sqrt(n * (n - 3) / (n + 1))) if level > 0 else 0
    if 3 * min(up(fit), runs, serial) < 0.01:
        return None
    share = max(secrets.STRUCTURED, 1.6 / k)
    expected = share * n * (n - 1) / 2
    p = up((expected - (squares - n) / 2) / math.sqrt(expected + n * (n - 1) * (n - 2) / 2 * share * share))
    return f"{name}:{int(math.log2(n))}", min(int(-math.log10(p) * 10), 300)


def plain(rows, q=0.05):
    tested, strata = [], collections.defaultdict(list)
    for i, (_, text) in enumerate(rows):
        text = text or ""
        bare = list(text)
        for a, _, b in base_spans(text):
            bare[a:b] = " " * (b - a)
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", "".join(bare)):
            token = m.group().rstrip("=")
            found = re.search("[0-9]", token) and re.search("[A-Za-z]", token) and battery(token)
            if found:
                tested.append((i, m.start(), m.end(), *found))
                strata[found[0]].append(found[1])
    cut = {s: min((b for b in bins if len(bins) * 10 ** (-b / 10) <= q * sum(x >= b for x in bins)), default=999) for s, bins in strata.items()}
    out = []
    for i, (d, text) in enumerate(rows):
        base = sorted(base_spans(text))
        spans = sorted(base + [(a, 3, b) for j, a, b, s, x in tested if j == i and x >= cut[s]])
        show = lambda xs: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in xs)
        out.append((d, *(sum(k == x for _, k, _ in base) for x in range(3)), hashlib.sha256(show(base).encode()).hexdigest(), show(spans)))
    return sorted(out, key=repr)


def some_texts(rnd):
    token = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    word = lambda n: "".join(rnd.choice(["tion", "er", "the", "an", "st", "9", "in"]) for _ in range(n))
    texts = [None, "", "no secrets here", "token = \"" + token(D + "abcdef", 40) + '"', "PassWord:abc123 passwd=abcde", "secret:token:abcdefgh", "api_key='x+/=.-_y' APIKEY = zzzzzz",
             "AKIA" + token(U + D, 16) + " AKIASHORT AKIAAKIA" + token(U + D, 20), "é😀ü " + token(D + "abcdef", 24) + " 😀" + token(D + "abcdef", 23), "token=token=token=abc", "ſecret=abcdefgh toKen=abcdefgh",
             "0123456789abcdefghijklmnopqrstuvwxyz " + "a1" * 30, "secret=" + token(U + D, 5000) + " " + "word " * 100000 + "password=tail99"]
    for n in (20, 24, 32, 40, 64, 64, 64, 100, 1000):
        for alphabet in (U + L + D, U + L + D + "+/", U + L + D + "-_", D + L, U + "234567", D + "ABCDEF"):
            texts.append(f"{word(3)} {token(alphabet, n)}== {word(9)} x")
    texts += [" ".join(token(U + L + D, 80) for _ in range(400)), " ".join(f"token:{token(L, 9)}" for _ in range(700)), *(f"/{word(4)}/{word(5)}/{word(3)}" for _ in range(200))]
    return texts


def test_against_plain(spark, tmp_path):
    texts = some_texts(random.Random(7))
    rows = [*enumerate(texts), (None, texts[3]), (3, texts[3])]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS t", "'x' AS base", "2 AS tested", "3 AS spans").repartition(3).write.parquet(path)
    got = sorted((tuple(r)[:6] for r in secrets.summary(secrets.find(spark.read.parquet(path))).collect()), key=repr)
    want = plain(rows)
    assert got == want
    assert sum("random" in r[5] for r in want) > 10


def test_structured_strings_stay_out(spark):
    """Paths, ids of words and repeated patterns are not added; random strings of some length are."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice(["tion", "er", "the", "an", "st", "in", "ou2", "Al"]) for _ in range(12)) for _ in range(300)]
    keys = ["".join(rnd.choice(U + L + D) for _ in range(64)) for _ in range(100)]
    rows = [(i, f"see {w} there") for i, w in enumerate(words)] + [(1000 + i, f"see {k} there") for i, k in enumerate(keys)]
    found = {r.doc_id: r.spans for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(bool(found[i]) for i in range(300)) <= 5 and sum(bool(found[1000 + i]) for i in range(100)) >= 90


def test_empty_table(spark):
    assert secrets.summary(secrets.find(spark.createDataFrame([], "doc_id long, text string"))).count() == 0

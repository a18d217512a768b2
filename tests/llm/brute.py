"""Plain Python versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def repeats(rows, size):
    count, words = collections.Counter(), []
    for _, t in rows:
        w = WORD.findall(t or "")
        words.append(w)
        count.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def fingerprint(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, budget=3):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= budget:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def near_duplicates(rows):
    prints = [fingerprint(t) for _, t in rows]
    group, low = components(prints), collections.defaultdict(list)
    for (d, _), g in zip(rows, group):
        if d is not None:
            low[g].append(d)
    return [(d, format(f, "016x"), min(low[g], default=None)) for (d, _), f, g in zip(rows, prints, group)]


def contamination(docs, bench, size=13):
    windows = {}
    for i, t in bench:
        w = PLAIN.findall(lower(t))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for d, t in docs:
        w = PLAIN.findall(lower(t))
        hit, items = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    items |= windows[tuple(w[k : k + n])]
                    hit[k : k + n] = [1] * n
        ids = sorted(str(x) for x in items if x is not None)
        out.append((d, len(w), sum(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def suffix_tree(rows, s):
    def tokens(t):
        return WORD.findall(lower(t))

    def held(d):
        return d is None or zlib.crc32(str(d).encode()) % 5 == 1

    count, grams = collections.Counter(), collections.defaultdict(collections.Counter)
    for d, t in rows:
        if held(d):
            continue
        count.update([*tokens(t), "<end>"])
        symbols = ["E", *" ".join(tokens(t)).encode(), "E"]
        for i in range(1, len(symbols)):
            for k in range(min(i, s.depth) + 1):
                grams[tuple(symbols[i - k : i])][symbols[i]] += 1
    total, n, v = sum(grams[()].values()), sum(count.values()), len(count)
    kept = {()}
    for x in [x for x in grams if x and sum(grams[x].values()) >= max(2, s.p_min * total)]:
        own, up = sum(grams[x].values()), sum(grams[x[1:]].values())
        if sum(c / own * math.log((c / own) / (grams[x[1:]][k] / up)) for k, c in grams[x].items()) >= s.divergence:
            kept |= {x[i:] for i in range(len(x))}

    def p(x, a):
        if not x:
            return (grams[()][a] + 0.5) / (total + 0.5 * 257)
        return (grams[x][a] + s.smoothing * p(x[1:], a)) / (sum(grams[x].values()) + s.smoothing)

    out = []
    for d, t in rows:
        words = [*tokens(t), "<end>"]
        symbols, score = ["E", *" ".join(tokens(t)).encode(), "E"], 0.0
        for i in range(1, len(symbols)):
            k = next(k for k in range(min(i, s.depth), -1, -1) if tuple(symbols[i - k : i]) in kept)
            score += math.log10(p(tuple(symbols[i - k : i]), symbols[i]))
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in words)
        out.append((d, held(d), len(words), sum(count[x] > 0 for x in words), n, round(base, 6), round(score, 3)))
    return out


def cheapest_edits(turns):
    """(cost, audit, lines) of the best repair of [(role, text, fault)], built from the end for every state."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ()), "a": (0, "", ()), "u": (2, "I", (("assistant", ""),)), "s": (4, "II", (("user", ""), ("assistant", "")))}
    for role, text, fault in reversed(turns):
        here = {}
        for q in ("", "s", "u", "a"):
            found = []
            for n in range(3):
                state, lines = q, []
                for _ in range(n):
                    state = step[state, "a" if state == "u" else "u"]
                    lines.append((name[state], ""))
                cost, head = 2 * n, "I" * n
                c, a, rest = best[state]
                found.append((cost + 3 + c, head + "D" + a, (*lines, *rest)))
                if fault in ("blank", "duplicate"):
                    continue
                for letter, more, told in [("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")]:
                    to = step.get((state, told[:1]))
                    if to:
                        c, a, rest = best[to]
                        found.append((cost + more + (fault == "truncated") + c, head + letter + a, (*lines, (told, text), *rest)))
            here[q] = min(found, key=lambda x: x[:2])
        best = here
    return best[""]


def repair(rows):
    """Report of [(conv, turn, role, text)] that are damaged already."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, " " if r is None else r, hashlib.sha256((" " if x is None else x).encode()).digest(), " " if x is None else x) for c, t, r, x in rows if c == conv))
        seen, told, turns = set(), [], {t for known, t, *_ in mine if known}
        for *_, role, _, text in mine:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            told.append((role, text, fault))
        cost, audit, lines = cheapest_edits(told)
        pairs = zip(told, told[1:])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(f == x for *_, f in told) for x in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out

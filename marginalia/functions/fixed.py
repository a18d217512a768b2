"""Fixed values. Results depend on these exact word lists, keys, patterns and weights, so they are stated as plain text."""

# --- fixed values: tag-term stop lists -------------------------------------------------------------------------------
EN_STOPWORDS = (
    "the and with from that this have into your for using about "
    "note notes book books reading chapter section title page pages "
    "data system model models file files root copy source original"
).split()

NOISY_TOKENS = (
    "html css js svg div span node nodes active class classes body container header footer padding margin display "
    "position width height font family shadow color background gradient rgba queryselector document dataset const "
    "function click hover legend diagram marker arrowhead import imports trilium markdown highlight clone"
).split()

STRUCTURAL_TOKENS = (
    "archive archives journal journals notebooklm vault folder folders reading books book import imports attachments "
    "attachment daily template templates obsidian bridge"
).split()

STRUCTURAL_CJK = "归档 日志 日记 导入 附件 模板 阅读".split()

GENERIC_CJK = "内容 方法 系统 模型 分析 报告 研究 笔记 总结 实践 理论 基础 概念 原理 问题 策略 流程 框架 标准 资料".split()

# function characters that may not start, end or crowd a CJK term
CJK_FUNCTION_CHARS = "的了是在与和及并或对从将把为等由以其让使所而到于中上下内外前后再各就也很更最可能需要已未被向给按"
# characters a CJK run is cut at (no 了 here)
CJK_SPLIT_CHARS = "的是在与和及并或对从将把为等由以其让使所而到于中上下内外前后再各就也很更最可能需要已未被向给按"

CJK = "\\x{3400}-\\x{9fff}"
TERM_SPLIT = r"[/_|()\[\]{}:：,，。.!?？、\-\s]+"
CODE_LIKE = (
    r"(?i)[{};]|=>|(function|const |let |var |document\.|querySelector|classList|addEventListener|@media|"
    r"linear-gradient|rgba\(|box-shadow|font-family|display:|position:|padding:|margin:|width:|height:|cursor:|"
    r"transition:)"
)

# --- fixed values: suggestion weights --------------------------------------------------------------------------------
SOURCE_WEIGHT = {"title": 9, "alias": 7, "heading": 8, "reference": 7, "context": 5, "path": 2, "body": 3}
SOURCE_BONUS = {"title": 10, "heading": 7, "reference": 6, "alias": 5, "context": 4}
STRONG_SOURCES = ["title", "heading", "reference", "alias"]
FACET_BONUS = {"topic": 10, "method": 10, "dataset": 10, "writing_stage": 10, "status": 10, "theory": 8, "project": 8}
FACET_BONUS_OTHER = 6

# --- fixed values: relation keys -------------------------------------------------------------------------------------
LEGACY_RELATION_KEYS = ["related", "see_also", "parent", "child", "same_as"]
RESEARCH_RELATION_KEYS = [
    "supports", "contradicts", "extends", "uses_method", "uses_dataset", "same_question", "evidence_for",
    "counterargument_to", "reviews", "inspired_by",
]

# --- fixed values: default dimensions --------------------------------------------------------------------------------
DEFAULT_FACETS_JSON = """{
  "topic": {"research-question": ["研究问题", "research question", "rq"],
            "literature-review": ["文献综述", "literature review"],
            "research-gap": ["研究空白", "research gap"],
            "knowledge-synthesis": ["知识综合", "synthesis"]},
  "method": {"experiment": ["实验", "experimental"], "qualitative": ["定性研究", "qualitative"],
             "quantitative": ["定量研究", "quantitative"], "case-study": ["案例研究", "case study"],
             "mixed-methods": ["混合方法", "mixed methods"]},
  "dataset": {"survey": ["问卷", "survey"], "corpus": ["语料", "corpus"], "interview": ["访谈", "interview"],
              "field-notes": ["田野笔记", "field notes"]},
  "theory": {"framework": ["理论框架", "framework"], "model": ["模型", "model"], "proposition": ["命题", "proposition"]},
  "status": {"to-read": ["待读", "to read"], "annotated": ["已批注", "annotated"], "cited": ["已引用", "cited"]},
  "writing_stage": {"outline": ["提纲", "outline"], "draft": ["草稿", "draft"], "revision": ["修订", "revision"],
                    "final": ["定稿", "final"]},
  "source_kind": {"literature-note": ["文献笔记", "literature note", "paper note"],
                  "source-note": ["来源笔记", "source note"], "reading-note": ["阅读笔记", "reading note"],
                  "draft-note": ["写作草稿", "draft note"]}
}"""

# --- fixed values: works ---------------------------------------------------------------------------------------------
LITERATURE_FOLDER = "Knowledge/Research/Literature"
ATTACHMENTS_FOLDER = "Knowledge/Research/Attachments"
TOPICS_FOLDER = "Knowledge/Research/Topics"
ANALYSIS_FOLDER = "Knowledge/Research/Analysis"
DRAFTS_FOLDER = "Knowledge/Research/Drafts"
MAP_TAGS = [
    "data-governance", "digital-transformation", "intelligent-transformation", "governance-mechanism",
    "organizational-capability", "platform-governance",
]
METHOD_TAGS = ["framework", "case-study", "empirical", "conceptual"]
NON_TOPIC_TAGS = ["literature-note", "framework", "case-study", "empirical", "conceptual"]

# --- fixed values: migration -----------------------------------------------------------------------------------------
GENERIC_STEMS = ["2", "欢迎", "新建笔记", "1_新建笔记", "2_新建笔记", "Day Note Template"]
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL"] + [f"COM{i}" for i in range(1, 10)] + [f"LPT{i}" for i in range(1, 10)]
SKIPPED_IMPORT_PAGES = ["index.html", "navigation.html"]
SKIPPED_IMPORT_ASSETS = ["!!!meta.json", "root_grid.json", "style.css"]
ARTIFACT_SUFFIX = {
    "audio": ".m4a", "video": ".mp4", "slide_deck": ".pdf", "infographic": ".png", "report": ".md",
    "data_table": ".csv", "quiz": ".md", "flashcards": ".md",
}

# --- fixed values: feeds ---------------------------------------------------------------------------------------------
SEARCH_OPTIONS = {
    "sort_by": ["综合", "最新", "最多点赞", "最多评论", "最多收藏"],
    "note_type": ["不限", "视频", "图文"],
    "publish_time": ["不限", "一天内", "一周内", "半年内"],
    "search_scope": ["不限", "已看过", "未看过", "已关注"],
    "location": ["不限", "同城", "附近"],
}
BLOCKED_PAGE_KEYWORDS = [
    "当前笔记暂时无法浏览", "该内容因违规已被删除", "该笔记已被删除", "内容不存在", "笔记不存在", "已失效", "私密笔记",
    "仅作者可见", "因用户设置，你无法查看", "因违规无法查看",
]

# --- fixed values: speech text ---------------------------------------------------------------------------------------
CORRECTIONS = {
    "在显价值": "在险价值", "风险穗": "风险矩阵", "富力业变换": "傅里叶变换", "富力业": "傅里叶", "在显": "在险",
}
RECALL_TERMS = [
    "风险管理", "风险识别", "风险评估", "风险应对", "风险矩阵", "在险价值", "傅里叶变换", "梯度下降", "贝叶斯推断",
    "蒙特卡洛", "三道防线", "压力测试", "敏感性分析", "蒙特卡洛模拟",
]
REFRESH_PRIORITY = {"metadata": 0, "mutation": 1, "context": 2, "settings": 3}
SEMANTIC_EXCLUDED_FOLDERS = [".smart-env", "Archive/Imports", "Excalidraw", "note_reader"]
SEMANTIC_EXCLUDED_HEADINGS = ["目录", "Contents", "参考文献", "References", "Acknowledgements"]

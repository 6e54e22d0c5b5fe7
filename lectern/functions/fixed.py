"""Word lists and patterns that decide results, whole and in order of precedence.

Only values stand here; the rules that use them are in :mod:`lectern.functions.text` and :mod:`lectern.operators.extraction`.
"""

#: Heading keywords by section type; a heading's type is the first whose keyword it holds.
HEADING_KEYWORDS = [
    ("abstract", ["abstract", "摘要"]),
    ("references", ["references", "bibliography", "参考文献", "引用文献"]),
    ("acknowledgments", ["acknowledgment", "acknowledgement", "致谢", "鸣谢"]),
    ("appendix", ["appendix", "appendices", "supplement", "supplementary", "附录", "补充材料"]),
    ("related_work", ["related work", "related works", "literature review", "prior work", "previous work", "state of the art", "state-of-the-art", "相关工作", "文献综述", "相关研究"]),
    ("conclusion", ["conclusion", "conclusions", "concluding", "future work", "future research", "future directions", "summary", "closing remarks", "结论", "总结", "未来工作", "展望"]),
    ("results", ["result", "results", "finding", "findings", "performance", "ablation", "analysis", "validation", "case study", "case studies", "结果", "分析", "效果", "性能"]),
    ("discussion", ["discussion", "limitation", "limitations", "implication", "implications", "threats to validity", "讨论", "局限"]),
    ("experiments", ["experiment", "experiments", "experimental setup", "evaluation setup", "implementation", "implementations", "training", "training details", "dataset", "datasets", "benchmark", "benchmarks", "evaluation", "evaluations", "setup", "实验", "数据集", "训练"]),
    ("methods", ["method", "methods", "methodology", "approach", "approaches", "proposed method", "proposed approach", "proposed model", "model", "algorithm", "algorithms", "framework", "architecture", "system design", "design", "formulation", "problem statement", "problem formulation", "preliminaries", "definition", "definitions", "notation", "方法", "模型", "算法", "框架", "架构", "问题描述", "问题定义"]),
    ("intro", ["introduction", "background", "motivation", "overview", "objective", "objectives", "scope", "contribution", "contributions", "引言", "导论", "概述", "背景", "动机"]),
]

#: Patterns of query intents; a query's intent is the first of which a pattern matches.
INTENT_PATTERNS = [
    ("summary", [
        r"\bsummari[sz]e\b", r"\bsummary\b", r"\boverview\b", r"\btl;?dr\b", r"\bwhat (is|are) (this|the) paper", r"\babout the paper\b", r"\bmain contribution", r"\bkey takeaway",
        r"概述", r"概要", r"主要内容", r"核心观点", r"总结",
    ]),
    ("related_work", [
        r"\brelated work\b", r"\bliterature review\b", r"\bprior work\b", r"\bprevious work\b", r"\bstate[- ]of[- ]the[- ]art\b", r"\bsurvey of\b", r"\breview of (?:the )?literature\b",
        r"\bwhat has been done\b", r"\bexisting (?:approaches|methods|work)\b", r"\bhas anyone\b", r"相关工作", r"文献综述", r"已有工作", r"相关研究", r"前人工作", r"综述",
    ]),
    ("gap", [
        r"\bgaps?\b", r"\blimitation", r"\bweakness", r"\bshortcoming", r"\bopen (?:problem|question|challenge)", r"\bfuture work\b", r"\bfuture (?:research|direction)", r"\bunsolved\b", r"\bunaddressed\b",
        r"未解决", r"局限", r"不足", r"未来工作", r"改进空间", r"缺陷", r"空白",
    ]),
    ("methodology", [
        r"\bmethodolog", r"\bapproach\b", r"\bhow (?:does|do|did) (?:they|it|the)", r"\bhow (?:is|are) .* (?:implemented|computed|trained)", r"\balgorithm\b", r"\bmodel architecture\b", r"\bmodel design\b",
        r"\bproposed method\b", r"\bproposed approach\b", r"\btechnique used\b", r"\bimplementation detail", r"方法论", r"如何实现", r"怎么做", r"怎么实现", r"算法", r"模型架构", r"技术方案",
    ]),
    ("experiments_results", [
        r"\bresult", r"\bexperiment", r"\bevaluation\b", r"\bbenchmark", r"\bperformance\b", r"\baccuracy\b", r"\b(?:f1|f-1)\b", r"\bauc\b", r"\bablation\b", r"\boutperform", r"\b(?:vs\.?|versus)\b",
        r"\bcompared (?:to|with)\b", r"实验", r"结果", r"性能", r"效果", r"对比", r"评估", r"评测",
    ]),
    ("definitions", [
        r"\bwhat is\b", r"\bwhat are\b", r"\bdefine\b", r"\bdefinition of\b", r"\bmeaning of\b", r"\bconcept of\b", r"\bexplain the term\b", r"什么是", r"定义", r"概念", r"含义",
    ]),
]

#: Weights of section types by intent, and the intents that search viewpoints too.
INTENT_WEIGHTS = {
    "summary": {"abstract": 2.0, "conclusion": 2.0, "intro": 1.0},
    "methodology": {"methods": 2.5, "experiments": 1.0, "intro": 0.5},
    "experiments_results": {"results": 2.0, "experiments": 2.0, "discussion": 1.0},
    "related_work": {"related_work": 2.5, "intro": 1.5},
    "gap": {"discussion": 2.0, "conclusion": 1.5, "related_work": 1.0, "intro": 0.5},
    "definitions": {"intro": 2.0, "abstract": 1.5, "methods": 1.0},
    "default": {},
}
VIEWPOINT_INTENTS = ["related_work", "gap", "summary", "experiments_results"]

#: Beginnings of reference entries, by type; an entry's type is the first of which a pattern matches.
REFERENCE_STARTS = [
    [r"^\(\d+\)\s?"],
    [r"^\[\d{0,3}\].+?[\,\.，．]?"],
    [r"^［\d{0,3}］.+?[\,\.，．]?"],
    [r"^\d+[\,\.，．]"],
    [r"^\d+[^\d\w]+?[\,\.，．]?"],
    [r"^\[.+?\].+?[\,\.，．]?"],
    [r"^\d+\s+"],
    [r"^[A-Z]\w.+?\(\d+[a-z]?\)", r"^[A-Z][A-Za-z]+[\,\.，．]?", r"^.+?,.+.,", r"^[一-龥]{1,4}[\,\.，．]?"],
]

#: Lines of mastheads, licences, addresses and axis labels; True where case doesn't matter.
NOISE_LINES = [
    (r"^Contents\s+lists?\s+available\s+at", True),
    (r"^journal\s+homepage\s*[:：]", True),
    (r"^https?://", True),
    (r"^©\s*\d{4}", True),
    (r"^\(?cc\)?\s*by[-\s]", True),
    (r"^\d{3,4}-\d{3,4}\s*/", True),
    (r"^\*?\s*Corresponding\s+author", True),
    (r"^E-?mail\s+address(?:es)?\s*[:：]", True),
    (r"^Article\s+history\s*[:：]", True),
    (r"^Received\s+(?:in\s+revised\s+form|\d)", True),
    (r"^Accepted\s+\d", True),
    (r"^Available\s+online", True),
    (r"^Published\s+by\s+Elsevier", True),
    (r"^This\s+is\s+an\s+open[-\s]access\s+article", True),
    (r"^[A-Z][A-Za-z &-]{2,40}\s+\d+\s+\(\d{4}\)\s+\d", False),
    (r"^a\s+r\s+t\s+i\s+c\s+l\s+e\s+i\s+n\s+f\s+o\s*$", True),
    (r"^a\s+b\s+s\s+t\s+r\s+a\s+c\s+t\s*$", True),
    (r"^g\s+r\s+a\s+p\s+h\s+i\s+c\s+a\s+l\s+a\s+b\s+s\s+t\s+r\s+a\s+c\s+t\s*$", True),
    (r"^Keywords?\s*[:：]\s*$", True),
    (r"^Dataset\s+link\s*[:：]", True),
    (r"^\s*(?:State\s+Key\s+Lab|.*?(?:University|Institute|Laboratory|College|School|Department|Academy)).{5,}\b(?:China|USA|UK|Korea|Japan|India|Canada|Germany|France|Italy|Spain|Australia)\b", True),
    (r"^[a-z]\s*$", False),
    (r"^[A-Z][A-Za-z ]{2,30}\s*\[\s*(?:km/h|m/s|Nm|N\s*m|kW|kWh|kJ|MJ|m|s|ms|min|Hz|kg|°C|°|%|V|A|Ω|J|W|rad|rpm|deg|MPa|kPa|Pa)\s*\]\s*$", True),
]

#: Headings, in lower case, that open a section without a number.
SECTION_HEADINGS = [
    "introduction", "method", "methods", "methodology", "result", "results",
    "discussion", "conclusion", "conclusions", "background", "related work",
    "experiment", "experiments", "experimental", "evaluation", "implementation",
    "approach", "overview", "summary", "future work", "acknowledgment",
    "acknowledgements", "acknowledgement", "appendix", "references", "bibliography",
    "abstract", "literature review", "problem statement", "proposed method",
    "analysis", "case study", "limitation", "limitations", "model", "algorithm",
    "dataset", "data", "preliminaries", "formulation", "setup", "design",
    "performance", "validation", "ablation", "findings", "implications",
    "contributions", "contribution", "motivation", "objective", "objectives",
    "scope", "framework", "architecture", "training", "inference", "deployment",
    "引言", "方法", "结果", "讨论", "结论", "摘要", "参考文献", "致谢",
    "相关工作", "背景", "实验", "分析", "总结",
]

#: Fixed values of the search for references: pages that a document has at least, pages that are read first, the middle of a page (where lines never
#: run from page to page), and how much taller than others the letters of another part are.
LEAST_PAGES, LOADED_PAGES, PAGE_MIDDLE, TALLER_SPAN = 3, 3, (0.2, 0.8), 0.3

#: Fixed values of a paper's first page: what may stand before a title, labels before authors, lines that end them, words that are no name, and words that
#: show an institution.
TITLE_PREFIXES = [
    "Article", "Letter", r"Research(?:\s+Article)?", "Review", "Editorial", "Perspective", r"Brief\s+Communication", "Comment", r"News\s+(?:and|&)\s+Views",
    r"OPEN\s+ACCESS", r"Original\s+(?:Research|Article)", "Communication",
]
TITLE_LINK = r"(?:\s+(?:https?://\S+|doi\.org/\S+|10\.\d{4,9}/\S+))?"
AUTHOR_LABELS = [r"Graphical\s+abstract\s+(?:Authors?\s*[:：]?\s*)?", r"Authors?\s*[:：]\s*", r"By\s*[:：]\s*"]
AUTHOR_STOPS = ["Received", "Accepted", "Published", r"Available\s+online", "Correspondence", r"Check\s+for\s+updates", "DOI", "Editor", "https?://", r"\d{1,2}/\d{1,2}/\d{2,4}"]
NO_NAMES = ["member", "student member", "senior member", "fellow", "ieee", "life member", "life fellow", "associate member", "graduate student member", "and"]
NO_FIRST_WORDS = ["abstract", "abstract:", "keywords", "keywords:", "index", "received", "accepted", "published", "introduction", "article", "letter"]
INSTITUTIONS = [
    "University", "Institute", "College", "School", "Department", "Laboratory", "Center", "Centre", "Academy", "Corporation", "Corp", "Ltd", "Inc", "LLC", "GmbH",
    "SA", r"S\.A\.", "BV", r"B\.V\.", "AG", r"S\.L\.", "SARL", r"Co\.", r"Ltd\.", "PLC",
    "大学", "学院", "研究院", "研究所", "实验室", "中心", "科学院", "公司", "有限公司",
]
#: A marker behind a name, the label of an abstract, what ends an abstract, and what stands around keywords.
NAME_MARKER = r"\s+(?:[0-9,]+|[a-z]|[\*\†\‡\§\¶]+)\s*$"
ABSTRACT_LABEL = r"A\s?B\s?S\s?T\s?R\s?A\s?C\s?T\s*\n+"
ABSTRACT_ENDS = [
    r"\n\s*\n(?:A\s?R\s?T\s?I\s?C\s?L\s?E|G\s?R\s?A\s?P\s?H\s?I\s?C\s?A\s?L|(?:1|2|3|I|II|III)\.?\s+(?:Introduction|Method|Related|Background|System|Experiment|[A-Z][a-z]+)|\n(?:[A-Z]\s){2,})",
    r"\n\s*[✩✦✪∗\*†‡§¶]",
    r"\n\s*E-?mail\s+address(?:es)?\s*[:：]",
    r"\n\s*https?://(?:dx\.)?doi\.org/",
    r"\n\s*Received\s+\d",
    r"\n\s*©\s*\d{4}",
    r"\n\s*INDEX\s+TERMS\b",
    r"\n\s*KEYWORDS\s*[:：]",
    r"\n\s*(?:I|II|III|IV|V|VI|VII|VIII|IX|X)\.\s+[A-Z]",
    r"\n\s*\d+\.\s+(?:Introduction|Method|Methods|Background|Related\s+Work|Preliminaries|Overview|Literature\s+Review|Problem\s+Statement|Motivation)\b",
]
KEYWORD_LIST = r"\n(?:Keywords?|Index Terms)[\s:]*\n?(.*?)(?:\n(?:[A-Z]\s){2,}|\n\s*\n|\n(?:Introduction|1\.\s))"
#: Characters of an abstract without an end, and where on a page titles, authors and affiliations stand.
ABSTRACT_CHARS = 5000
TITLE_BAND, TITLE_PARTS_BAND, TITLE_WORDS, LOOSE_BAND, LOOSE_WORDS, NO_TITLE_AT = (0.07, 0.35), (0.07, 0.40), 4, 0.5, 5, 0.25
SAME_SIZE, LINE_GAP, AUTHORS_BELOW, AUTHORS_GAP, AUTHORS_SIZE, AFFILIATIONS_BELOW = 0.5, 1.6, (2, 60), 20, 8, (2, 120)
AUTHOR_SIZES, LEAST_AFFILIATION = (9, 12), 10

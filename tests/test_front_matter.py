import random
import re

from pyspark.sql import functions as F

from lectern.operators import front_matter as fm

BLOCK, PAGE = "doc int, seq int, text string, size double, y0 double, y1 double", "doc int, height double, text string"
NAMES = {"member", "student member", "senior member", "fellow", "ieee", "life member", "life fellow", "associate member", "graduate student member", "and"}
FIRST = {"abstract", "keywords", "index", "received", "accepted", "published", "introduction", "article", "letter"}
PREFIX = r"^\s*(?:Article|Letter|Research(?:\s+Article)?|Review|Editorial|Perspective|Brief\s+Communication|Comment|News\s+(?:and|&)\s+Views|OPEN\s+ACCESS|Original\s+(?:Research|Article)|Communication)(?:\s+(?:https?://\S+|doi\.org/\S+|10\.\d{4,9}/\S+))?\s+"


def literal_names(line):
    line = re.sub(r"^\s*(?:Graphical\s+abstract\s+(?:Authors?\s*[:：]?\s*)?|Authors?\s*[:：]\s*|By\s*[:：]\s*)", "", line.strip(), flags=re.I)
    if not line or line.split()[0].lower().rstrip(":") in FIRST:
        return []
    out = []
    for piece in line.split("|" if "|" in line else ","):
        for n in re.split(r"\s+(?:and|AND|&)\s+", piece.strip()):
            n = re.sub(r"^(?:and|AND|&)\s+", "", n.strip())
            for _ in range(5):
                n = re.sub(r"\s+(?:[0-9,]+|[a-z]|[*†‡§¶]+)\s*$", "", n)
            n = re.sub(r"\s{2,}", " ", n).strip()
            if len(n) >= 2 and not re.match(r"^[\d\s*.,]+$", n) and n.lower() not in NAMES and n.split()[0].lower().rstrip(":") not in FIRST:
                out.append(n)
    return out


def literal(blocks, height):
    words = lambda b: len(b["text"].split())
    pool = [b for b in blocks if 0.07 <= b["y0"] / height <= 0.35 and words(b) >= 4] or [b for b in blocks if words(b) >= 5 and b["y0"] / height < 0.5]
    title, bottom = "", height * 0.25
    if pool:
        main = sorted(pool, key=lambda b: (-b["size"], -words(b)))[0]
        like = sorted((b for b in blocks if 0.07 <= b["y0"] / height <= 0.40 and words(b) and abs(b["size"] - main["size"]) < 0.5), key=lambda b: b["y0"])
        run = [main]
        if any(b is main for b in like):
            k = next(i for i, b in enumerate(like) if b is main)
            lo = hi = k
            while lo and like[lo]["y0"] - like[lo - 1]["y1"] < main["size"] * 1.6:
                lo -= 1
            while hi + 1 < len(like) and like[hi + 1]["y0"] - like[hi]["y1"] < main["size"] * 1.6:
                hi += 1
            run = like[lo : hi + 1]
        whole = " ".join(b["text"].strip() for b in run if b["text"].strip())
        title, bottom = re.sub(PREFIX, "", whole, flags=re.I).strip() or whole, max(b["y1"] for b in run)
    below = sorted((b for b in blocks if bottom + 2 < b["y0"] < bottom + 60 and b["size"] >= 8), key=lambda b: b["y0"])
    line, upto = "", below[0]["y0"] if below else 0
    for b in below:
        if b["y0"] - upto > 20 or re.match(r"(?i)^\s*(?:Received|Accepted|Published|Available\s+online|Correspondence|Check\s+for\s+updates|DOI|Editor|https?://|\d{1,2}/\d{1,2}/\d{2,4})", b["text"]):
            break
        line, upto = line + " " + b["text"], max(upto, b["y1"])
    names = literal_names(line)
    low = bottom + 20
    if names:
        low = max([low, *(b["y1"] for b in blocks if b["y0"] > bottom and 9 <= b["size"] <= 12)])
    places = []
    for b in sorted((b for b in blocks if low + 2 < b["y0"] < low + 120 and re.search("(?i)University|Institute|大学|Inc", b["text"])), key=lambda b: b["y0"]):
        for part in re.split(r"\s{2,}(?=[a-z]\s{2,})", b["text"]):
            part = re.sub(r"^[a-z0-9,*\s]+", "", part).strip()
            if len(part) > 10:
                places.append(part)
    return title, names, places


TEXTS = ["Article https://doi.org/10.1/x Deep learning of large graphs", "Deep learning of large graphs", "for Road Information", "Applied Energy", "Ann Lee 1, Bob Roe 2,* and Cy Poe b", "Ann Lee 1,2 | Bob Roe † | member",
         "Authors: Di Fox, IEEE, AND JO SU", "Received 3 May", "a  University of Somewhere b  Institute of Other Things", "Some University, City", "Abstract: text of a paper", "12", "  ", "Review", "five words in this block"]


def test_front_matter_against_the_rule(spark):
    r, blocks, pages = random.Random(8), [], []
    for doc in range(300):
        y = r.choice([10.0, 50.0, 90.0])
        pages.append((doc, 800.0, ""))
        whole = doc % 6 == 0
        y = 90.0 if whole else y
        for k in range(3 if whole else r.randint(0, 9)):
            high = r.choice([10.0, 20.0])
            text, size = r.choice(TEXTS), r.choice([8.0, 10.0, 12.0, 18.0, 18.3, 7.0])
            if whole:  # title, authors, affiliations
                text, size = TEXTS[[0, 4, 8][k]], [18.0, 10.0, 8.0][k]
            blocks.append((doc, k, text, size, y, y + high))
            y += high + 5.0 if whole else r.choice([high + 2.0, high + 15.0, high + 60.0, 0.0])
    got = {x.doc: (x.title, x.authors, x.affiliations) for x in fm.front_matter(spark.createDataFrame(blocks, BLOCK).repartition(3), spark.createDataFrame(pages, PAGE)).collect()}
    full = 0
    for doc in range(300):
        own = [{"text": b[2], "size": b[3], "y0": b[4], "y1": b[5]} for b in blocks if b[0] == doc]
        want = literal(own, 800.0)
        assert got[doc] == want, doc
        full += all(want)
    assert full > 5


def test_texts_of_a_page(spark):
    page = "x\nA B S T R A C T\n\nmeta\nABSTRACT \nFirst line\nof it. 10.1234/abc.d \nDataset link: none\n\n\n\nNext  part\n© 2017 Them\nKeywords: trees, graphs;\nlong words.\n\nmore"
    other = "a\nAbstract\n" + "word " * 2000 + "\nIndex Terms\nab; c, deep nets.\nIntroduction"
    open_ = "a\nabstract\n" + "word " * 2000
    got = spark.createDataFrame([(0, page), (1, other), (2, "none"), (3, open_)], "i int, t string").select("i", fm.abstract(F.col("t")).alias("a"), fm.keywords(F.col("t")).alias("k"), fm.page_doi(F.col("t")).alias("d")).orderBy("i").collect()
    assert got[0].a == "First line of it. 10.1234/abc.d \n Next part" and got[0].k == ["trees", "graphs", "long words"] and got[0].d.startswith("10.1234/abc.d")
    assert got[3].a == ("word " * 1000).strip() and got[1].a == ("word " * 2000).strip() and got[1].k == ["ab", "deep nets"] and got[1].d is None
    assert (got[2].a, got[2].k, got[2].d) == ("", [], None)


def test_titles_of_layout_blocks(spark):
    kind = "doc int, seq int, block struct<type:string,text:string,text_level:int,page_idx:int>"
    rows = [(0, 0, ("text", "a text of words", None, 0)), (0, 1, ("title", "short", 1, 0)), (0, 2, ("title", "References", 1, None)), (0, 3, ("title", "Second level", 2, 0)), (0, 4, ("title", " A title of a paper ", None, 0)), (0, 5, ("title", "Another title", 1, 0)), (1, 0, ("text", "x", None, 1)), (1, 1, ("title", "Too late a title", 1, 0))]
    found = fm.block_titles(spark.createDataFrame(rows, kind))
    assert [(r.doc, r.title) for r in found.collect()] == [(0, "A title of a paper")]
    fronts = spark.createDataFrame([(0, "A title"), (1, "Kept title")], "doc int, title string")
    assert sorted((r.doc, r.title) for r in fm.with_block_titles(fronts, found).collect()) == [(0, "A title of a paper"), (1, "Kept title")]


def test_an_abstract_takes_each_pattern_once(spark):
    """A pattern goes over the whole text: splits at the label and at the end are each in the plan once."""
    from lectern.operators.front_matter import abstract

    out = spark.createDataFrame([("Abstract\nWhat it says.\n\n1. Introduction\nmore",), ("nothing",), (None,)], "text string").select(abstract(F.col("text")).alias("a"))
    assert [r.a for r in out.collect()] == ["What it says.", "", ""]
    assert out._jdf.queryExecution().analyzed().toString().count("split(") == 2

"""The search for references and their entries against a literal scan, and each branch by hand."""

import random
import re

from pyspark.sql import functions as F

from lectern.operators import extraction, layout, reference_list

LINE = "doc int, page int, seq int, x double, y double, width double, height double, heights array<double>, text string, url string"
PAGE = "doc int, page int, width double, height double"
KINDS = [r"^\(\d+\)\s?", r"^\[\d{0,3}\].+?", r"^［\d{0,3}］.+?", r"^\d+[\,\.，．]", r"^\d+[^\d\w]+?", r"^\[.+?\].+?", r"^\d+\s+", r"^[A-Z]\w.+?\(\d+[a-z]?\)|^[A-Z][A-Za-z]+|^.+?,.+.,|^[一-龥]{1,4}"]


def kind(text):
    trimmed, tight = text.strip(), re.sub(r"\s+", "", text)
    return next((i for i, p in enumerate(KINDS) if re.search(p, trimmed) or re.search(p, tight)), -1)


class Scan:
    """One document, read line by line from its end."""

    def __init__(self, pages, sizes, full):
        self.pages, self.sizes, self.total, self.full = pages, sizes, len(sizes), full
        self.parts, self.listed, self.open = [], [], []

    def heads_removed(self, p):
        at_hand = [q for q in range(self.total) if q >= min(p, self.total - 3)]
        w, h = (max(self.sizes[q][k] for q in at_hand) for k in (0, 1))
        plain = lambda r: ("" if re.match(r"^[A-Z]{1,3}$", r["text"]) else re.sub(r"\s+|\d+", "", r["text"]), *(round(r[c]) for c in ("x", "y", "width", "height")))
        keep = []
        for r in self.pages[p]:
            middle = r["x"] / w > 0.2 and r["y"] / h > 0.2 and (r["x"] + r["width"]) / w < 0.8 and (r["y"] + r["height"]) / h < 0.8
            if middle or not any(plain(o) == plain(r) for q in at_hand if q != p for o in self.pages[q]):
                keep.append(r)
        return [r for r in keep if not re.match(r"(?i)^(Table|Fig|Figure).*\d", re.sub(r"\s+", "", r["text"]))]

    def close(self, listed=False):
        if self.open:
            self.parts.append(self.open[::-1])
            if listed:
                self.listed.append(len(self.parts) - 1)
        self.open = []

    @staticmethod
    def alike(a, b):
        return any(x - y < min(x, y) * 0.3 for x in a["heights"] for y in b["heights"])

    def page(self, p):
        rows = self.heads_removed(p)
        column, box = -1, []
        for r in rows:
            if not box or r["y"] < box[-1]["y"] or all(r["x"] > o["x"] + o["width"] for o in box) or all(r["x"] + r["width"] < o["x"] for o in box):
                column, box = column + 1, []
            box.append(r)
            r["column"] = column
        if not rows:
            return False
        value = lambda r: (r["x"], r["y"], r["width"], r["height"], r["text"])
        ends = [r for r in rows if all(value(o) == value(r) or o["x"] + o["width"] < r["x"] + r["width"] or o["y"] < r["y"] for o in rows)]
        end = (ends or rows)[-1]
        if re.search(r"(图|fig|Fig|Figure).*\d+", re.sub(r"\s+", "", end["text"])):
            return False
        names = lambda r: not self.full and bool(re.search(r"(?i)(参考文献|reference|bibliography)", re.sub(r"\s+", "", r["text"]))) and len(re.sub(r"\s+", "", r["text"])) < 20
        for i in range(max(k for k, r in enumerate(rows) if r is end), -1, -1):
            r = rows[i]
            if self.open and not self.alike(self.open[-1], r):
                self.close()
                self.open = [r]
                continue
            if names(r):
                return self.ends_list()
            self.open.append(r)
            if i and (not self.alike(r, rows[i - 1]) or (r["column"] == rows[i - 1]["column"] and abs(r["y"] - rows[i - 1]["y"]) > 3 * r["height"])):
                if names(rows[i - 1]):
                    return self.ends_list()
                self.close()
        return False

    def ends_list(self):
        if not self.open:
            return False
        number = re.match(r"^\d+", self.open[-1]["text"].strip())
        self.close(listed=True)
        return not number or number.group() == "1"

    def run(self):
        if self.total < 3:
            return []
        for p in range(self.total - 1, -1 if self.full else 0, -1):
            if self.page(p):
                return [r for k in reversed(self.listed) for r in self.parts[k]]
        if self.full:
            return self.parts
        return max(self.parts, key=lambda part: sum(kind(r["text"]) >= 0 for r in part), default=[])


def random_document(r, doc):
    total, rows = r.randint(1, 6), []
    sizes = [(600.0 + 10 * r.randint(0, 1), 800.0) for _ in range(total)]
    for p in range(total):
        y, x, page = 10.0, 50.0, []
        page.append({"text": f"Journal of Tests {p}", "x": 60.0, "y": 10.0, "width": 100.0, "height": 8.0, "heights": [8.0]})
        for _ in range(r.choice([0, 3, 9, 14])):
            y += r.choice([12.0, 12.0, 12.0, 12.0, 50.0])
            if r.random() < 0.1:
                y, x = 40.0, x + r.choice([0.0, 250.0])
            height = r.choice([10.0] * 8 + [14.0, 20.0])
            text = r.choice(["[1] One, a, b.", "[2] Two, c, d.", "plain words", "1. Roe", "References", "Bibliography", "Figure 3 shows", "see fig 2", "2 Doe", "12", "ABC", "more words-"])
            heights = [height] if r.random() < 0.8 else [height, r.choice([6.0, 13.5])]
            page.append({"text": text, "x": x + r.choice([0.0, 0.0, 12.5]), "y": y, "width": r.choice([180.0, 200.0]), "height": height, "heights": heights})
        page.append({"text": f"{p + 1}", "x": 300.0, "y": 780.0, "width": 20.0, "height": 8.0, "heights": [8.0]})
        rows.append([{**line, "doc": doc, "page": p, "seq": k, "url": None} for k, line in enumerate(page if r.random() < 0.95 else [])])
    return rows, sizes


def frames(spark, documents):
    names = [c.split()[0] for c in LINE.split(", ")]
    lines = [tuple(line[n] for n in names) for rows, _ in documents for page in rows for line in page]
    pages = [(d, p, w, h) for d, (_, sizes) in enumerate(documents) for p, (w, h) in enumerate(sizes)]
    return spark.createDataFrame(lines, LINE).repartition(3), spark.createDataFrame(pages, PAGE)


def test_search_against_a_literal_scan(spark):
    r = random.Random(11)
    documents = [random_document(r, d) for d in range(400)]
    lines, pages = frames(spark, documents)
    got: dict = {}
    for x in reference_list.reference_lines(lines, pages).orderBy("doc", "page", "seq").collect():
        got.setdefault(x.doc, []).append((x.page, x.seq))
    parts: dict = {}
    for x in reference_list.text_parts(lines, pages, full_text=True).filter("finished").orderBy("doc", "part", "page", "seq").collect():
        parts.setdefault((x.doc, x.part), []).append((x.page, x.seq))
    n_listed = 0
    for d, (rows, sizes) in enumerate(documents):
        scan = Scan(rows, sizes, False)
        assert got.get(d, []) == [(x["page"], x["seq"]) for x in scan.run()], d
        n_listed += bool(scan.listed)
        whole = Scan(rows, sizes, True).run()
        assert [parts[k] for k in sorted(parts) if k[0] == d] == [[(x["page"], x["seq"]) for x in part] for part in whole], d
    assert n_listed > 40 and sum(len(s) < 3 for _, s in documents) > 40


def column_of(texts, doc=0, page=2, x=50.0, top=100.0, step=12.0):
    return [{"doc": doc, "page": page, "seq": k, "x": x + (t[1] if isinstance(t, tuple) else 0.0), "y": top + step * k, "width": 300.0, "height": 10.0, "heights": [10.0], "text": t[0] if isinstance(t, tuple) else t, "url": None} for k, t in enumerate(texts)]


def test_entries_with_hanging_and_first_line_indents(spark):
    hanging = column_of(["Lee, A deep study of graphs and", ("words in trees. 2019", 15.0), "Kim, Another study of long con-", ("tinued lines, 2020", 15.0), "Roe, Third, x, 2021"], doc=1)
    first = column_of([("Lee, A deep study of graphs and", 15.0), "words in trees, of, 2019", ("Kim, Another study of long", 15.0), "lines, of, 2020"], doc=2)
    flat = column_of(["[1] Lee. A title-", "and more, of, text.", "[2] Kim. Title", "(3) not this kind"], doc=3)
    early = column_of(["7 seven things", "[1] One", "8 eight"], doc=4)
    lines, _ = frames(spark, [([hanging], []), ([first], []), ([flat], []), ([early], [])])
    got: dict = {}
    for e in reference_list.reference_entries(lines.withColumn("page_x", F.col("x"))).orderBy("doc", "entry").collect():
        got.setdefault(e.doc, []).append(e.text)
    assert got[1] == ["Lee, A deep study of graphs and words in trees. 2019", "Kim, Another study of long continued lines, 2020", "Roe, Third, x, 2021"]
    assert got[2] == ["Lee, A deep study of graphs and words in trees, of, 2019", "Kim, Another study of long lines, of, 2020"]
    assert got[3] == ["[1] Lee. A titleand more, of, text.", "[2] Kim. Title (3) not this kind"]
    assert got[4] == ["7 seven things [1] One", "8 eight"]


def test_stray_lines_at_the_end_are_cut(spark):
    rows = column_of([f"[{k}] Entry" for k in range(1, 20)] + [("footer far away", 400.0), "[20] lost"])
    lines, _ = frames(spark, [([rows], [])])
    got = [e.text for e in reference_list.reference_entries(lines.withColumn("page_x", F.col("x"))).orderBy("entry").collect()]
    assert got == [f"[{k}] Entry" for k in range(1, 20)]


def test_from_lines_to_references(spark):
    body = column_of(["words of a body"] * 4, page=1)
    listed = column_of(["References", "[1] Zhou P. A deep model for long texts. Nature, 2019.", "[2] Lee K et al. “Graphs of many words in trees,” Big Journal 12 (2020),", "doi: 10.1234/abc.5 x"])
    front = column_of(["front"], page=0)
    documents = [([front, body, listed], [(600.0, 800.0)] * 3)]
    got = reference_list.references(*frames(spark, documents), this_year=F.lit(2024)).orderBy("entry").collect()
    assert [(r.number, r.title, r.authors, r.year, r.venue) for r in got] == [
        (1, "A deep model for long texts", "Zhou P.", "2019", "Nature"), (2, "Graphs of many words in trees", "Lee K et al.", "2020", "Big Journal"),
    ]
    assert got[1].url.startswith("https://doi.org/10.1234/abc.5") and got[0].text.startswith("Zhou")
    assert reference_list.references(*frames(spark, [([front, body], [(600.0, 800.0)] * 2)])).count() == 0


def literal_info(text, this_year):
    text = re.sub(r"\s+", " ", re.sub(r"^\[\d+?\]", "", text))
    quoted = re.search("“(.+)”", text)
    if quoted:
        mark, title = quoted.group(0), re.sub(",$", "", quoted.group(1))
    else:
        pieces = text.split(". ") if ". " in text else text.split(".")
        noise = lambda s: sum(len(re.findall(p, s)) for p in (r"[A-Z]\.", r"[,.\-():]", r"\d")) / max(1, len(s))
        fit = [s for s in pieces if s.count(" ") >= 3]
        if not fit:
            return text, None, None, None
        mark = min(fit, key=noise).strip()
        title = re.sub(r"\[[A-Z]\]$", "", mark)
    before, _, after = text.partition(mark)
    venue = re.search(r"[^.\s].+[^.]", after.split(mark)[0])
    venue = re.split(r"[,\d]", venue.group())[0].strip() if venue else ""
    names = before.strip()
    names = names.split("et al.")[0] + "et al." if "et al." in names else names
    years = [y for y in (re.search(r"\d+", m).group() for m in re.findall(r"[^\d]\d{4}[^\d-]", text)) if int(y) <= this_year + 1]
    if years:
        for m in (f"({years[0]})", f"{years[0]}.", years[0]):
            names = names.replace(m, "").strip()
        names = re.sub(r"\s+\.$", "", re.sub(r"\(\s*\)", "", names).strip()).strip()
    return title.strip(), names or None, years[0] if years else None, venue


def test_parsed_entries_against_the_rule(spark):
    r = random.Random(4)
    bits = ["Lee, K.", "A. B.", "and", "a long title of words", "Graphs (2019).", "et al.", "Nature 12, 3-4", "2030.", "1999-2000", "[J]", "“Quoted words of a title,”", "deep. ", "pp. 12345", "(2001)", "of x.y", "title of words [J]. "]
    texts = [" ".join(r.choice(bits) for _ in range(r.randint(0, 9))) for _ in range(500)] + ["", " ", "[12] a b c d", "a b c d. a b c d. x"]
    got = extraction.parsed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), this_year=F.lit(2024)).orderBy("i").collect()
    for t, g in zip(texts, got, strict=True):
        assert (g.title, g.authors, g.year, g.venue) == literal_info(t, 2024), t


def test_spans_to_lines(spark):
    spans = [
        (0, 0, 0, 10.04, 20.0, 30.0, 10.0, "A", None), (0, 0, 1, 40.0, 24.0, 5.0, 4.0, " 2 ", "u"), (0, 0, 2, 50.0, 31.0, 20.0, 10.0, "next", None), (0, 0, 3, 70.0, 29.0, -20.0, 12.0, "up", None),
        (0, 0, 4, 0.0, 60.0, 1.0, 8.0, "  ", None), (0, 0, 5, 1.0, 80.0, 1.0, 8.0, "x", None), (0, 0, 6, 1.0, 79.0, 1.0, 6.0, "y", "v"), (0, 0, 7, 1.0, 79.0, 1.0, 6.0, "z", None), (0, 1, 0, 1.0, 80.0, 1.0, 8.0, "other page", None),
    ]
    df = spark.createDataFrame(spans, "doc int, page int, seq int, x double, y double, width double, height double, text string, url string")
    got = [(r.page, r.seq, r.x, r.y, r.width, r.height, r.text, r.url) for r in layout.lines_of_spans(df).orderBy("page", "seq").collect()]
    # "up" ends below the line "next" began in; "y" ends within the line of "x".
    assert got == [(0, 0, 10.0, 20.0, 35.0, 10.0, "A 2", "u"), (0, 1, 50.0, 31.0, 40.0, 10.0, "next up", None), (0, 2, 1.0, 80.0, 3.0, 6.0, "x y z", "v"), (1, 0, 1.0, 80.0, 1.0, 8.0, "other page", None)]

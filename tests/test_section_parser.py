import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lectern.operators import layout, section_parser

LINE = "doc int, page int, column int, seq int, x double, y double, height double, text string"
WORDS = ["1. Introduction", "Related work", "Approach of ours", "Limitations", "Proposed method for trees", "A Tall Line Of Words", "References", "2. Bibliography and more", "3.1 Setup Of Tests", "body words that go on", "broken hy-", "words after", "x = 5", "∑ i", "ends here.", "E-mail address: x", "Overview", "tiny", "--", "Framework", "1. Lee, A. Title"]


def literal(lines, flags):
    """Sections by the rule, from lines in reading order with (heading?, level, equation?) each."""
    out, buf, listed = [], [], False

    def flush():
        if out:
            out[-1]["lo"], out[-1]["hi"] = min([out[-1]["lo"], *(r["page"] + 1 for r in buf)]), max([out[-1]["hi"], *(r["page"] + 1 for r in buf)])
            body = Counter(round(r["height"], 1) for r in buf).most_common(1)[0][0] if buf else 0
            paragraphs = [[buf[0]["text"]]] if buf else []
            for was, r in zip(buf, buf[1:], strict=False):
                if flags[r["seq"]][2]:
                    continue
                if abs(r["y"] - was["y"] - was["height"]) > 2.5 * body or r["x"] - was["x"] > 1.5 * body:
                    paragraphs.append([r["text"]])
                elif was["text"].endswith("-"):
                    paragraphs[-1][-1] = paragraphs[-1][-1].rstrip("-") + r["text"]
                else:
                    paragraphs[-1].append(r["text"])
            out[-1]["p"] += [t for t in (" ".join(p).strip() for p in paragraphs) if len(t) > 10]
        buf.clear()

    for r in lines:
        head, level, _ = flags[r["seq"]]
        low = re.sub("[.:]+$", "", r["text"].lower()).strip()
        names = low in ("references", "bibliography", "reference list") or bool(re.match(r"^(?:\d+\.\s+)?(?:references|bibliography)\b", low))
        if head and (names or not listed):
            flush()
            out.append({"h": r["text"], "level": level, "lo": r["page"] + 1, "hi": r["page"] + 1, "p": []})
            listed |= names
        else:
            buf.append(r)
    flush()
    merged = []
    for s in out:
        if merged and merged[-1]["h"] == s["h"]:
            merged[-1]["p"] += s["p"]
            merged[-1]["hi"] = max(merged[-1]["hi"], s["hi"])
        else:
            merged.append(s)
    return [(s["h"], s["level"], s["lo"], s["hi"], s["p"]) for s in merged]


def test_sections_against_the_rule(spark):
    r, rows = random.Random(5), []
    for doc in range(150):
        y, page, column = 0.0, 0, 0
        for k in range(r.randint(0, 40)):
            y += r.choice([12.0, 12.0, 12.0, 40.0])
            if r.random() < 0.1:
                page, column, y = page + r.randint(0, 1), r.randint(0, 1), 0.0
            rows.append((doc, page, column, k, r.choice([0.0, 0.0, 20.0]), y, r.choice([10.0, 10.0, 9.0, 16.0]), r.choice(WORDS)))
    lines = spark.createDataFrame(rows, LINE).repartition(3)
    marked = section_parser.marked_headings(lines)
    body = {(x.doc, x.seq): x.body for x in marked.collect()}
    flagged = marked.withColumn("raw", layout.is_heading(F.col("text"), F.col("height"), F.col("body"))).withColumn("eq", layout.is_equation(F.col("text"))).orderBy("doc", "place").collect()
    got: dict = {}
    for s in section_parser.sections(lines).orderBy("doc", "section").collect():
        got.setdefault(s.doc, []).append((s.heading, s.level, s.page_start, s.page_end, s.paragraphs))
    seen = Counter()
    for doc in range(150):
        own = [x.asDict() for x in flagged if x.doc == doc]
        if own:
            heights = Counter(round(x["height"], 1) for x in own)
            assert {body[doc, x["seq"]] for x in own} == {heights.most_common(1)[0][0]}
        assert got.get(doc, []) == literal(own, {x["seq"]: (x["raw"], x["level"], x["eq"]) for x in own}), doc
        seen.update(s[0] for s in got.get(doc, []))
    assert {"Approach of ours", "Limitations", "Overview", "Framework", "Proposed method for trees", "A Tall Line Of Words"} <= set(seen)


def test_own_list_of_headings(spark):
    texts = ["Approach", "overview", "Limitations:", "Model", "Proposed method", "Problem statement: trees", "Ablation of parts", "Something else", "Data that has far too many words in it"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [x.h for x in df.select("i", layout.is_heading(F.col("t"), F.lit(10.0), F.lit(10.0)).alias("h")).orderBy("i").collect()]
    assert got == [True] * 7 + [False] * 2


def test_sections_read_marked_lines_that_are_written_once(spark):
    rows = [(1, 0, 0, k, 0.0, 12.0 * k, 10.0, t) for k, t in enumerate(["Results", "A line of body text that is long.", "Conclusion", "Another line of body text."])]
    found = section_parser.sections(spark.createDataFrame(rows, LINE))
    assert found.inputFiles() and all("/marked-" in f for f in found.inputFiles())
    assert [(r.heading, len(r.paragraphs)) for r in found.orderBy("section").collect()] == [("Results", 1), ("Conclusion", 1)]

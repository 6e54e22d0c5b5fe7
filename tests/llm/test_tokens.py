"""Token counts, token alignment and collocations against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import regex

from lectern.llm import alignment, collocations, token_counts
from lectern.llm.common import table
from tests.conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (1, "Hello  world<|endoftext|> don't\n\n stop <|endoftext|>"), (2, None), (3, ""), (None, "no id ՘౜1 \U0003fc3b!"), (5, "   "), (5, "   "), (5, "the same id, another text"),
    (6, "café ﬁne Å ▁x \x00 　 日本語 \U0001f600"), (7, "a" * 40_000 + " " + "word " * 30_000), (8, "<s> </s> <unk> <0x41>"), (9, "x ▁ y"), (10, " leading and trailing "),
    (11, "tabs\tand\r\nlines\x0b\x0c."),
]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def reference_counts(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    out = []
    for doc_id, text in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        out.append((doc_id, len((text or "").encode()), n, n > 512))
    return sorted(out, key=str)


def test_token_counts_on_odd_rows(spark, make):
    got = token_counts.count_tokens(make(ODD), A, token_counts.CountSpec(frequent=3, batch_rows=10, long_text=1000))
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == reference_counts(ODD)


def test_token_counts_on_documents(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(token_counts.count_tokens(docs, A), "doc_id", "n_bytes", "n_tokens", "over_limit") == reference_counts(rows)


def test_splitting_agrees_with_the_library_on_every_letter_of_the_ranges():
    s = token_counts.Splitter(A)
    agreed = regex.compile(f"[{s.AGREED}]")
    pre = s.encoder.tokenizer.pre_tokenizer
    for c in map(chr, range(0xA4D0)):
        if agreed.match(c):
            x = f"a{c}1{c}!{c} {c}"
            assert s.pattern.findall(x) == [x[lo:hi] for _, (lo, hi) in pre.pre_tokenize_str(x)]


def test_tokens_of_an_empty_table(spark, make):
    empty = make(ODD).filter("false")
    assert token_counts.count_tokens(empty, A).count() == 0
    assert alignment.align_documents(empty, A, B).count() == 0
    assert collocations.collocations(empty).count() == 0


def reference_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    letters = alignment.Encoder.of(A).fast

    def piece(i):
        p = tb.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    docs, count = [], Counter()
    for doc_id, text in rows:
        a, b, whole = ta.encode(" " + (text or ""), add_special_tokens=False).ids, tb.encode(text or ""), b" " + (text or "").encode()
        xa, xb = [letters.decode_single_token_bytes(i) for i in a], [piece(i) for i in b]
        if not text or b"".join(xa) != whole or b"".join(xb) != whole:
            docs.append((doc_id, [], [], [], []))
            continue
        ends = []
        for own in (xa, xb):
            at, out = 0, []
            for x in own:
                at += len(x)
                out.append(at)
            ends.append(out)
        shared = sorted(set(ends[0]) & set(ends[1]))
        by_a, by_b = dict(zip(ends[0], a, strict=True)), dict(zip(ends[1], b, strict=True))
        links = [(by_a[e], by_b[e]) for e in shared]
        groups, lo = [], 0
        for hi in shared:
            groups.append(",".join(str(i) for i, e in zip(a, ends[0], strict=True) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(b, ends[1], strict=True) if lo < e <= hi)) if len(shared) < 2000 else None
            lo = hi
        docs.append((doc_id, a, b, links, groups))
        count.update(links)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for doc_id, a, b, links, groups in docs:
        sha = "" if not a else None if len(links) >= 2000 else hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc_id, len(a), len(b), len(links), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), sha))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_on_odd_rows_and_long_texts(spark, make):
    expected = reference_alignment(ODD)
    got = rows_of(alignment.align_documents(make(ODD), A, B, alignment.AlignSpec(batch_chars=40, stretch=50, batch_rows=7)), *COLUMNS)
    assert [r[:7] for r in got] == [r[:7] for r in expected]
    assert all(x[7] == y[7] for x, y in zip(got, expected, strict=True) if y[7] is not None)
    assert sum(r[7] is not None and r[7] != "" for r in expected) >= 6 and sum(r[7] == "" for r in expected) >= 4


def test_alignment_on_documents(spark):
    docs = table(spark, SF, "documents").filter("length(text) < 6000")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got, expected = rows_of(alignment.align_documents(docs, A, B), *COLUMNS), reference_alignment(rows)
    assert [r[:7] for r in got] == [r[:7] for r in expected]
    assert all(x[7] == y[7] for x, y in zip(got, expected, strict=True) if y[7] is not None)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    ids, starts, sizes = [np.asarray([1, 2, 1, 2, 3, 1, 2]), np.asarray([5, 6, 5, 7, 5, 6])], [np.asarray([0, 2, 4, 5]), np.asarray([0, 2, 3, 4])], [np.asarray([2, 2, 1, 2]), np.asarray([2, 1, 1, 2])]
    for weak in (False, True):
        if weak:
            monkeypatch.setattr(alignment.np, "add", type("Weak", (), {"reduceat": staticmethod(lambda v, at: np.zeros(len(at), v.dtype) if v.dtype == np.uint64 else np.bincount(np.searchsorted(at, np.arange(len(v)), side="right") - 1, v, len(at)))}))
        first, kind = alignment.distinct_windows(ids, starts, sizes)
        assert kind[0] == kind[3] and len({*kind.tolist()}) == 3 and all(kind[f] == k for k, f in enumerate(first.tolist()) if k in kind)


def test_links_are_bounded_by_the_vocabularies():
    assert alignment.pair_bound(alignment.Aligner(A, B)) < 1_000_000


def reference_phrases(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = defaultdict(list)
    for (lang, w), a in cand.items():
        if any(x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * b >= 80 * a for (x, v), b in cand.items()):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, own in out.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:top]))


def phrase_rows(seed=3):
    r = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "of", "the", "é", " ", "x'y", "BIG", "d"]
    rows = []
    for k in range(400):
        body = [r.choice(words) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            body.insert(r.randint(0, len(body)), r.choice(["new york city hall", "of the", "alpha\tbeta gamma", "once. upon", f"rare{k} thing"]))
        rows.append((k, r.choice([" ", "  ", "\n", ", "]).join(body), r.choice(["en", None, "und", "de"])))
    return [*rows, (1, None, "en"), (1, "", "fr"), (None, "the of " * 9000, "en"), (2, "y z " * 50, "fr"), (2, "y z " * 50, "fr")]


@pytest.mark.parametrize("spec", [
    collocations.PhraseSpec(), collocations.PhraseSpec(block_chars=500, bitmap_bits=7, hot_part=4, partition_rows=300, sort_rows=64, small=2), collocations.PhraseSpec(least=5, top=7, small=3, hot_part=1),
])
def test_collocations_against_brute_force(spark, make, spec):
    rows = phrase_rows()
    got = rows_of(collocations.collocations(make(rows), spec), "lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert got == sorted(reference_phrases([(r[2], r[1]) for r in rows], spec.least, spec.top), key=str)


def test_scores_past_64_bits(spark):
    big = 4 * 10**18
    counts = spark.createDataFrame([("en", 2, "p q", big), ("en", 1, "p", 2 * big), ("en", 1, "q", 2 * big + 1), ("en", 3, "p q p", big // 2)], "lang string, words int, phrase string, f bigint")
    totals = spark.createDataFrame([("en", 9 * 10**18)], "lang string, n bigint")
    counts = counts.unionByName(spark.createDataFrame([("en", 2, "q p", big - 1)], counts.schema))
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in collocations.ranked(counts, totals).collect()}
    assert got["p q"] == (big, 2 * big, 2 * big + 1, 2_000_000 * big // (4 * big + 1))
    assert got["p q p"][3] == min(2_000_000 * (big // 2) // (2 * big + big - 1), 2_000_000 * (big // 2) // (big + 2 * big))


def test_quicksort_counts_prefixes():
    import numpy as np

    r = np.random.default_rng(1)
    words = r.integers(0, 5, (3000, 4))
    for k in range(1, 4):
        words[words[:, k - 1] == 0, k] = 0
    weight = r.integers(1, 4, 3000)
    expected = Counter()
    for w, n in zip(words.tolist(), weight.tolist(), strict=True):
        for d in range(1, 5):
            if w[d - 1]:
                expected[tuple(w[:d])] += n
    for small in (1, 50, 10_000):
        got = {tuple(words[p, :d].tolist()): int(n) for at, d, c in collocations.multikey_quicksort(words, weight, 12, small) for p, n in zip(at, c, strict=True)}
        assert got == {k: n for k, n in expected.items() if n >= 12}

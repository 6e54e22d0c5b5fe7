"""Language, quality, toxicity and packing."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import language_id, packing, quality, queries, toxicity
from lectern.llm.common import table

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_languages(spark, make):
    got = queries.op2_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert len(got) == 200 and out and all(held(r.doc_id) for r in out) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in out) >= 0.9 * len(out)
    rows = [(1, "the house and the dog the", "en"), (2, "der hund und das haus der", "de"), (3, None, "en"), (4, "", None), (5, "12 + 34", None), (6, "the the the", None), (None, "der der", None), (6, "the the the", None)]
    docs = make([*rows, *((i, rows[i % 2][1], rows[i % 2][2]) for i in range(10, 30))])
    got = language_id.identify(docs, language_id.learn_profiles(docs)).collect()
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert {(3, "und"), (4, "und"), (5, "und"), (6, "en"), (None, "de")} <= by and len(got) == 28
    none = make([(1, "abc", None)])
    assert language_id.identify(none, language_id.learn_profiles(none)).first().lang_pred == "und"
    assert language_id.identify(make([]), language_id.learn_profiles(make([]))).count() == 0


def brute_grams(text):
    """An n-gram's count by its text; words padded by a space; one to three characters, with a letter in the middle of three."""
    parts = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    joined, n = " " + " ".join(parts) + " ", Counter()
    for k in (1, 2, 3):
        n.update(joined[i : i + k] for i in range(len(joined) - k + 1) if joined[i : i + k].strip() and (k < 3 or joined[i + 1] != " "))
    return n if parts else Counter()


def brute_ranked(n, size):
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], len(x[0]), x[0].replace(" ", "\1")))][:size]


@pytest.mark.parametrize("size, per_pass", [(400, 5_000), (30, 2), (5, 1)])
def test_languages_equal_brute_force(make, size, per_pass):
    """Every document's language and score by the rule itself: ranks, distances, and both kinds of ties."""
    rng = np.random.default_rng(4)
    vocab = {lang: ["".join(rng.choice(list(letters), rng.integers(1, 6))) for _ in range(25)] for lang, letters in {"aa": "abcé", "ab": "abcé", "b": "bcdÄ", "c": "xyz日本", "rare": "qrs"}.items()}
    rows = [(i, " ".join(rng.choice(vocab[lang], rng.integers(1, 40))) + rng.choice(["", "!", " 12"]), lang) for i, lang in enumerate(rng.choice(["aa", "ab", "b", "c"], 150))]
    rows += [(500 + i, " ".join(rng.choice(vocab["rare"], 6)), "rare") for i in range(3)]
    rows += [(600, "a", None), (601, "a b", None), (602, "x", None), (603, "", None), (604, None, "aa"), (605, "…12", "b"), (606, "ab " * 200_000, None)]
    counts = {}
    for i, t, lang in rows:
        if lang is not None and t is not None and not held(i):
            counts.setdefault(lang, Counter()).update(brute_grams(t))
    profiles = {lang: brute_ranked(n, size) for lang, n in counts.items()}
    docs = make(rows)
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.learn_profiles(docs, size, per_pass=per_pass)).collect()}
    for i, t, _ in rows:
        mine = brute_ranked(brute_grams(t), size)
        apart = {lang: sum(abs(p.index(g) - k) if g in p else size for k, g in enumerate(mine)) for lang, p in sorted(profiles.items())}
        best = min(apart, key=apart.get)
        assert (got[i].lang_pred, round(got[i].score, 9)) == ((best, round(1 - apart[best] / (size * len(mine)), 9)) if mine else ("und", 0)), i


def test_rare_languages_are_kept(make):
    rows = [(i, "one two three four", "en") for i in range(3000)] + [(10_000 + i, "eins zwei drei vier", "de") for i in range(10)]
    docs = make(rows)
    profiles = language_id.learn_profiles(docs, docs_per_language=50)
    assert profiles.load(0).languages == ["de", "en"]
    assert {r.lang_pred for r in language_id.identify(make([(1, "drei vier")]), profiles).collect()} == {"de"}


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {i + k for i in range(len(words) - 4) for k in range(5) if windows[tuple(words[i : i + 5])] > 1}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), n < 10 or 100 * len(marked) > 20 * n


def test_quality(spark, make):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in queries.op4_line_quality(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, r in got.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(texts[i])
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    judged = [(labels[i], r.kept) for i, r in got.items() if i in labels and not r.base_failed]
    assert sum(bool(q) == k for q, k in judged) >= 0.9 * len(judged)
    odd = [(1, None), (2, ""), (3, "a b\x1fc d é " * 30), (4, "x y z\nx y z\n\n \n" * 5), (None, "word " * 12), (3, "q")]
    model = quality.train(make([]), table(spark, SF, "labels"))
    for r in quality.judge(make(odd), model).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in [brute_base(t) for _, t in odd]
    assert quality.judge(make([]), model).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    field = quality.Field(rng.normal(size=len(quality.FEATURES)), rng.normal(size=(2, 2)))
    docs = [rng.random((n, len(quality.FEATURES))) < 0.4 for n in (0, 1, 5, 8)]
    for d, path in zip(docs, field.viterbi(docs), strict=True):
        def worth(p):
            return sum((x @ field.emit) * k for x, k in zip(d, p)) + sum(field.move[a, b] for a, b in zip(p, p[1:]))
        every = [[k >> i & 1 for i in range(len(d))] for k in range(1 << len(d))]
        assert np.isclose(worth(path.astype(int).tolist()), max(map(worth, every)))


def test_expectations_sum_over_all_labellings():
    rng, sizes = np.random.default_rng(1), np.asarray([4, 3, 1])
    potential, move = rng.normal(size=(3, 4)), rng.normal(size=(2, 2))
    chances, pairs = quality.expectations(potential, move, sizes)
    expected = np.zeros((2, 2))
    for i, n in enumerate(sizes):
        every = [[k >> j & 1 for j in range(n)] for k in range(1 << n)]
        worth = np.exp([sum(potential[i, j] * y for j, y in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])) for p in every])
        worth /= worth.sum()
        assert np.allclose(chances[i, :n], worth @ np.asarray(every))
        for w, p in zip(worth, every):
            for a, b in zip(p, p[1:]):
                expected[a, b] += w
    assert np.allclose(pairs, expected)


def test_mixed_documents_are_labelled_line_by_line(spark, make):
    """Documents of runs of content and of boilerplate, with a field learned from marks of whole documents only."""
    docs, labels = table(spark, SF.replace("0.001", "0.01"), "documents"), table(spark, SF.replace("0.001", "0.01"), "labels")
    field, rng = quality.train(docs, labels), np.random.default_rng(0)
    lines = {0: [], 1: []}
    for r in docs.join(labels, "doc_id").collect():
        if not quality.read_document(r.text).base_failed:
            lines[1 - r.quality] += [x for x in r.text.split("\n") if x.split()]
    rows, truth = [], {}
    for i in range(200):
        kinds = [k for k in rng.permutation([0, 1, i % 2, 0][: rng.integers(2, 5)]) for _ in range(rng.integers(1, 7))]
        own = [lines[k][rng.integers(len(lines[k]))] for k in kinds]
        rows.append((i, "\n".join(own)))
        truth[i] = (kinds, sum(len(x.split()) for x, k in zip(own, kinds) if not k) / sum(len(x.split()) for x in own))
    got = {r.doc_id: r for r in quality.judge(make(rows), field).collect()}
    inside = [i for i, (_, share) in truth.items() if 0 < share < 1]
    assert len(inside) > 100 and sum(0 < got[i].content_share < 1 for i in inside) > 0.7 * len(inside)
    assert np.mean([abs(got[i].content_share - share) for i, (_, share) in truth.items()]) < 0.08
    right = [b == bool(k) for i, (kinds, _) in truth.items() for b, k in zip(field.viterbi([quality.read_document(rows[i][1]).lines])[0], kinds)]
    assert np.mean(right) > 0.93
    clear = [i for i, (_, share) in truth.items() if abs(share - 0.5) > 0.15 and not got[i].base_failed]
    assert np.mean([got[i].kept == (truth[i][1] > 0.5) for i in clear]) > 0.95
    long = quality.judge(make([(1, "\n".join(lines[0] * 3)), (2, "x" * 3_000_000)]), field).orderBy("doc_id").collect()
    assert long[0].n_lines == 3 * len(lines[0]) and long[1].n_words == 1


def test_automaton_equals_edit_distance():
    trie = toxicity.Trie(["moron", "clown", "pathetic"], ["vequ"])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for w in ["moron", "morron", "mor0n", "oron", "clowns", "crown", "claun", "patetic", "pathetics", "xmoron", "mo", "mron", "clow", "morons", "abcde"]:
        best = min(distance(w, t) for t in ("moron", "clown", "pathetic"))
        found = trie.near(w)
        assert (found[1] if found else None) == (best if best <= (len(w) >= 5) else None), w
    assert trie.stem("vequxyz") == "vequ" and trie.stem("veq") is None


def test_automaton_allows_two_edits_from_ten_letters_on():
    def distance(a, b):
        rows = np.arange(len(b) + 1)
        for i, x in enumerate(a, 1):
            last, rows = rows, np.full(len(b) + 1, i)
            for j, y in enumerate(b, 1):
                rows[j] = min(last[j] + 1, rows[j - 1] + 1, last[j - 1] + (x != y))
        return int(rows[-1])

    terms, rng = ["fool", "moron", "imbecile", "degenerate", "incompetent", "incompetents", "troglodytes"], np.random.default_rng(5)
    trie, two = toxicity.Trie(terms, []), 0
    for _ in range(1500):
        w = list(terms[rng.integers(len(terms))])
        for _ in range(rng.integers(4)):
            at, kind = rng.integers(len(w)), rng.integers(3)
            w[at : at + (kind > 0)] = [] if kind == 1 else [chr(97 + rng.integers(26))]
        w = "".join(w)
        best, found = min(distance(w, t) for t in terms), trie.near(w)
        assert (found[1] if found else None) == (best if best <= (0 if len(w) < 5 else 1 if len(w) < 10 else 2) else None), w
        two += best == 2 and found is not None
    assert two > 100


def test_lexicon_keeps_families_and_rare_terms(spark):
    forms = ["idiot", "idiots", "idiotic"]
    rows = [(f"some plain words here you {forms[i % 3]}" + " zorblax" * (i < 12), 1) for i in range(1000)] + [("some plain words here for you", 0)] * 2000
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    found = {w: k for w, (k, _) in lexicon.lookup({"idiot", "idiotics", "idjot", "zorblax", "zarblax", "plain"}).items()}
    assert found == {"idiot": "exact", "idiotics": "stem", "idjot": "near", "zorblax": "exact", "zarblax": "near"}


def test_lexicon_forgets_and_remembers(monkeypatch):
    """Whatever has been forgotten, a text's hits are those of a fresh lexicon."""
    monkeypatch.setattr(toxicity, "CACHE_ENTRIES", 12)
    rng, words = np.random.default_rng(1), ["moron", "morom", "clown", "clawn", "vequx", "vequy", *(f"plain{chr(97 + i)}" for i in range(26))]
    used = toxicity.Lexicon(["clown", "moron"], ["vequ"])
    for _ in range(300):
        text = " ".join(rng.choice(words, rng.integers(1, 9)))
        assert used.features(text) == toxicity.Lexicon(["clown", "moron"], ["vequ"]).features(text)
        assert len(used.seen) <= 12 and len(used.old_seen) <= 12


def test_toxicity_of_the_given_table(spark):
    """Held-out documents: recall, false alarms and the order of scores, by the table's labels; very long texts too."""
    sf = SF.replace("0.001", "0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = ([r.score for r in got if r.toxic == k] for k in (1, 0))
    assert len(toxic) > 30 and np.mean([s >= 0.5 for s in toxic]) > 0.85 and np.mean([s >= 0.5 for s in clean]) < 0.02
    assert np.mean([t > c for t in toxic for c in clean]) > 0.93  # the chance that a toxic one stands before a clean one
    assert model.scores(["plain " * 300_000, None])[0] < 0.5


def test_toxicity(spark, make):
    rows = [(i, f"some plain words here number{i} " + ("you absolute moronix fool" if i % 4 == 0 else "good day")) for i in range(400)]
    docs = make([*rows, (900, None), (901, ""), (902, 'they said "moronix" once'), (903, "what a moronix"), (None, "you moronix")])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400)) and all(got[i].held_out == held(i) for i in range(400))
    assert got[900].predicted == got[901].predicted == 0 and got[900].score == got[901].score
    assert got[902].score < got[0].score
    assert toxicity.reject(docs, model).columns == docs.columns
    blank = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(make([(1, "x")]), blank).first().predicted == 0
    assert toxicity.score(make([]), model).count() == 0


def test_packing_round_trip(spark, make):
    tok = Tokenizer.from_file(BPE)
    texts = [r.text for r in table(spark, SF, "documents").collect()] + [None, "", "a  b", " lead", "trail ", "x <|endoftext|> y", "a.\nB", "\n\n\tq", "é  z", "x y z", "don't " * 30, "lo ng" * 9000, " " * 3_000_000 + "x", "-" * 50_000, "1" * 50_000, "日本語 😀 １２ \x85 \u3000a", "<|endoftext|>", "same", "same"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "null id")]
    got = packing.pack(make(rows), BPE).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(tok.encode(t or "", add_special_tokens=False).ids + [0])
    place = {}
    for r in got:
        part = ids[r.doc_id][0][r.start : r.start + r.length]
        assert zlib.crc32(np.asarray(part, "<u4").tobytes()) == r.ids_crc32 and len(part) == r.length
        assert r.length <= 2048 and (r.length == 2048 or r.piece == 0)
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in place.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:])) and sum(spans[-1]) <= 2048
    total = sum(len(x) for v in ids.values() for x in v)
    assert sum(r.length for r in got) == total and len(place) <= -(-total // 2048) + 2
    assert packing.pack(make([]), BPE).count() == 0


def test_best_fit_equals_a_plain_search():
    lengths = np.random.default_rng(2).integers(1, 60, 300)
    sequence, offset = packing.best_fit_decreasing(lengths, 64)
    left, expected = [], 0
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [x for x in left if x >= n]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - n)
        else:
            expected += 1
            left.append(64 - n)
    assert len(set(sequence.tolist())) == expected
    assert all(offset[i] + lengths[i] <= 64 for i in range(len(lengths)))


@pytest.mark.parametrize("name", ["op1_sharding", "op2_language_id"])
def test_registered(name):
    assert name in queries.QUERIES

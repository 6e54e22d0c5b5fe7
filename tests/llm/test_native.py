"""Sharding, mixing and quotation linking: queries against SQL, and edge cases."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import queries
from lectern.llm.mixing import MixSpec, mix, mix_plan, split
from lectern.llm.quotations import reply_ordered
from lectern.llm.sharding import CommitConflict, ShardSpec, ShardStore, compacted

SF = "/root/testdata/sf0.001"


def plain(x):
    return f"{x:.6g}" if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(queries.SQL[name])
    names = [c[0] for c in result.description]
    expected = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == expected


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Targets by source: all sizes shared by weight, the excess over each cap shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, out, open_ = {s: weights[i % 3] for i, s in enumerate(names)}, {}, set(names)
    while True:
        left = sum(sizes.values()) - sum(out.values())
        share = {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= cap * sizes[s]}
        if not over or over == open_:
            return out | ({s: cap * sizes[s] for s in over} if over else share)
        out |= {s: cap * sizes[s] for s in over}
        open_ -= over


def check_mix(rows, got, docs):
    """rows: (doc_id, text, source). Targets by brute force; words near them; draws disjoint and in many shards."""
    sizes, source = {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        source[i] = s
    targets, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and abs(r.target - targets[s]) < 1e-6 * max(1, targets[s])
        assert 0 <= r.taken <= 3 * r.size and (len(r.draws) - 1) * r.size < r.taken <= len(r.draws) * r.size or r.taken == len(r.draws) == 0
    assert all(abs(taken[s] - targets[s]) <= 3 for s in sizes)
    mixed = docs.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r._shard, r._order) for r in mixed) == sorted((r.doc_id is None, r.doc_id or 0, d.shard, d.local_order) for r in got for d in r.draws)
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixed) == sum(r.taken for r in got)
    return {d.shard for r in got for d in r.draws}


def test_mix_reaches_targets_and_caps(spark, make):
    rows = [(i, "w " * (1 + i % 7), "en", s) for i, s in enumerate(["a"] * 300 + ["b"] * 20 + [None] * 50)] + [(1000, None, "en", "b"), (5, "w", "en", "a"), (5, "w", "en", "a"), (1001, "long " * 40_000, "en", "c"), (1002, "", "en", "c")]
    plain_rows = [(i, t, s) for i, t, _, s in rows]
    got = mix_plan(make(rows)).collect()
    assert len(check_mix(plain_rows, got, mix(make(rows)))) >= 12
    assert sorted(map(str, mix_plan(make(rows)).collect())) == sorted(map(str, got))
    assert set(make(rows).columns) <= set(mix(make(rows)).columns)
    assert mix_plan(make([])).count() == 0 and mix(make([])).count() == 0
    # The same rows with sources in groups of one and tasks of three shards.
    small = MixSpec(docs_per_block=2, sources_per_group=1, shards_per_task=3, min_shards=20)
    assert check_mix(plain_rows, mix_plan(make(rows), small).collect(), mix(make(rows), small)) <= set(range(20))
    unnamed = mix_plan(make([(None, f"text {i}") for i in range(40)])).collect()
    assert sum(r.taken for r in unnamed) == 80


def test_mix_query(spark):
    from lectern.llm.common import table

    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert len(check_mix(rows, queries.op10_source_mixing(spark, SF).collect(), mix(docs))) >= 24
    # Local order: a shard's rows lie together, sorted by the seeded hash.
    found = mix(docs).selectExpr("spark_partition_id() AS p", "_shard", "_order").collect()
    assert len({(r.p, r._shard) for r in found}) == len({r._shard for r in found})
    assert [(r.p, r._shard, r._order) for r in found] == sorted((r.p, r._shard, r._order) for r in found)


def leaves_of(groups, n_shards, seed, step=1000):
    """{shard: {(group, source): (offset, count)}} from all tasks."""
    out = {k: {} for k in range(n_shards)}
    totals = np.asarray([sum(g) for g in groups])
    for g, quotas in enumerate(groups):
        for first in range(0, n_shards, step):
            for shard, at, start, have in split(totals, g, np.asarray(quotas), n_shards, first, first + step, seed):
                out[shard] |= {(g, int(i)): (int(s), int(n)) for i, s, n in zip(at, start, have)}
    return out


@pytest.mark.parametrize("step", [1, 2, 1000])
def test_splitting_tree_is_exact(step):
    groups, n = [[10, 0, 7], [23, 1]], 5
    leaves = leaves_of(groups, n, 1, step)
    assert leaves == leaves_of(groups, n, 1) and {sum(c for _, c in v.values()) for v in leaves.values()} <= {8, 9}
    for g, quotas in enumerate(groups):
        for i, q in enumerate(quotas):
            spans = sorted(v[g, i] for v in leaves.values() if (g, i) in v)
            assert sum(c for _, c in spans) == q and all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:])) and (not spans or spans[0][0] == 0)


def test_splitting_tree_has_the_joint_law():
    """Counts of one shard of two follow the multivariate hypergeometric law, with sources in groups too."""
    for groups in ([[3, 2, 3]], [[3, 2], [3]]):
        seen = Counter()
        for seed in range(4000):
            v = leaves_of(groups, 2, seed)[0]
            seen[tuple(v.get((g, i), (0, 0))[1] for g, q in enumerate(groups) for i in range(len(q)))] += 1
        every = {(a, b, c): math.comb(3, a) * math.comb(2, b) * math.comb(3, c) / math.comb(8, 4) for a in range(4) for b in range(3) for c in range(4) if a + b + c == 4}
        assert set(seen) == set(every)
        assert sum((seen[k] - 4000 * p) ** 2 / (4000 * p) for k, p in every.items()) < 35  # 9 degrees of freedom or so; far in the tail


def test_shards(spark, make, tmp_path):
    rows = [(i, "x" * 40) for i in range(64)] + [(None, None), (None, "no id"), (3, "x" * 40), (3, "x" * 40), (64, "y" * 5000)]
    store = ShardStore(spark, str(tmp_path / "store"), ShardSpec(arrival_rows=4, min_bytes=64, target_bytes=1000))
    assert store.version() == 0 and store.append(make(rows)) == 1
    first = store.manifest()
    assert store.compact() == 2
    after = store.manifest()
    assert after.count() < first.count() and after.agg({"n_rows": "sum"}).first()[0] == len(rows) == store.read(1).count()
    assert all(len(r.files) == 1 for r in after.filter("shard like 'm%'").collect())
    assert len({(r.batch, r.files[0]) for r in after.filter("shard like 'm%'").collect()}) == after.filter("shard like 'm%'").count()
    content = lambda df: sorted(map(str, df.select("row.doc_id", "row.text").collect()))
    expected = sorted(map(str, make(rows).select("doc_id", "text").collect()))
    assert content(store.read()) == content(store.read(1)) == expected
    settled = store.settle()
    assert store.settle() == settled and content(store.read()) == expected
    # Merged shards are between half and one and a half times the target, or the rest of a tier.
    small = store.manifest().filter("n_bytes < 500").groupBy("tier").count().collect()
    assert all(r["count"] == 1 for r in small)
    # A further append with a further column.
    store.append(make([(900, "late")]).withColumn("more", F.lit(7)))
    assert sorted((r.more is None, r.doc_id) for r in store.read().select("row.*").filter("doc_id >= 64").collect()) == [(False, 900), (True, 64)]
    assert compacted(make([])).count() == 0
    assert {r.arrival for r in compacted(make([(None, "a"), (None, "b"), (None, "c"), (1, "d"), (10**6, "e")])).collect()} >= {0, 15625}


def test_shard_commits(spark, make, tmp_path):
    """A crash before the rename, a second writer, and a vacuum while another append is under way."""
    store = ShardStore(spark, str(tmp_path / "store"), ShardSpec(arrival_rows=4, min_bytes=64, target_bytes=1000))
    store.append(make([(i, "x" * 40) for i in range(8)]))
    before = store.manifest()
    (tmp_path / "store" / "log" / ".draft-dead").write_text("")  # what a writer leaves that dies between create and rename
    (tmp_path / "store" / "log" / ".draft-half").write_text('{"manif')
    assert store.version() == 1 and store.read().count() == 8 and store.append(make([(8, "y")])) == 2
    with pytest.raises(CommitConflict):
        store._commit(before, 1, store._entry(1)["schema"])
    assert store.version() == 2 and store.read().count() == 9
    # Another writer has written its batch and not committed yet: a vacuum must not take it.
    other, commit, held = ShardStore(spark, store.root, store.spec), ShardStore._commit, []
    other._commit = lambda *a: held.append(a) or -1
    other.append(make([(9, "z")]))
    store.settle()
    assert store.vacuum() == 0
    with pytest.raises(CommitConflict):  # its parent is no longer the latest
        commit(other, *held[0])
    manifest, _, schema = held[0]
    assert commit(other, store.manifest().unionByName(manifest.join(store.manifest(2), ["batch", "shard"], "left_anti")), store.version(), schema) == store.version()
    assert store.read().count() == 10
    assert store.vacuum(keep=1, min_age=0) > 0 and store.read().count() == 10


def test_shard_tiers(spark):
    """On the given table several tiers remain, one small shard at most in each."""
    got = queries.op1_sharding(spark, SF.replace("0.001", "0.01"))
    shards = got.groupBy("tier", "shard").agg(F.sum("n_bytes").alias("b")).collect()
    assert len({r.tier for r in shards}) >= 2 and len(shards) == len({r.tier for r in shards})


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello  World\nsecond line here"), (1, 1, "bot", "> hello world\nMy answer"), (1, 2, "user", "On Monday X wrote:\n> My answer\n> > hello world\nthanks"),
        (1, 3, "bot", "plain"), (2, 0, "user", ">> plain\nok"), (2, 1, "user", None), (None, None, None, "> hello world"), (2, 1, "user", None), (3, 0, "u", ">\n> nobody said this"),
    ]
    got = {(r.conv_id, r.turn): r for r in reply_ordered(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS key", "2 AS level")).collect()}
    assert len(got) == len(rows) - 1
    assert (got[1, 1].reply_turn, got[1, 1].clean_text, got[1, 1].max_level) == (0, "My answer", 1)
    assert (got[1, 2].reply_turn, got[1, 2].clean_text, got[1, 2].n_quoted) == (1, "thanks", 2)
    assert (got[1, 3].thread_start, got[1, 3].thread_parent) == (2, 1)
    assert (got[2, 0].reply_conv, got[2, 0].reply_turn, got[2, 0].thread_start) == (1, 3, None)
    assert got[2, 1].clean_text == "" and got[3, 0].reply_conv is None
    assert got[None, None].reply_conv == 1


def test_quotations_of_other_conversations(spark):
    """A line that the quoting conversation wrote only later is another conversation's, though its own id is the smallest."""
    rows = [
        (1, 0, "user", "> shared line\nanswer"), (1, 1, "bot", "shared line"), (2, 4, "user", "shared line"), (2, 7, "bot", "Shared  line"), (3, 0, "user", "shared line"),
        (4, 0, "user", "> shared line"), (5, 0, "user", "> only here\nonly here"),
    ]
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in reply_ordered(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert (got[1, 0], got[4, 0], got[5, 0]) == ((2, 4), (1, 1), (None, None))


def brute_quotes(messages):
    """The rule itself, message by message: {(conv, turn, role, text): (quoted, passages, lines, reply, thread, position)}."""
    rows = sorted(set(messages), key=repr)

    def parsed(text):
        out = []
        for line in (text or "").split("\n"):
            mark = re.match(r"^[ \t>]*", line)[0]
            norm = re.sub(r"[ \t\r]+", " ", line[len(mark):]).strip(" ").lower()
            if norm:
                out.append((mark.count(">"), norm))
        return out

    def runs(lines):
        out = []
        for level, norm in lines:
            if out and out[-1][0] == level:
                out[-1][1].append(norm)
            else:
                out.append((level, [norm]))
        return out

    wrote = {}  # what: {conv: first turn}
    for conv, turn, _, text in rows:
        if turn is None:
            continue
        for level, norms in runs(parsed(text)):
            if level == 0:
                for what in [("p", *norms), *(("l", n) for n in norms)]:
                    at = wrote.setdefault(what, {})
                    at[conv] = min(at.get(conv, turn), turn)

    def source(what, conv, turn):
        at = wrote.get(what, {})
        if conv is not None and turn is not None and at.get(conv, turn) < turn:
            return conv, at[conv]
        others = sorted(c for c in at if c is not None and c != conv)
        return (others[0], at[others[0]]) if others else None

    found = {}
    for m in rows:
        conv, turn, _, text = m
        lines, votes, passages, single = parsed(text), Counter(), 0, 0
        for level, norms in runs(lines):
            if level == 0:
                continue
            if s := source(("p", *norms), conv, turn):
                votes[level, s] += len(norms)
                passages += 1
            else:
                for n in norms:
                    if s := source(("l", n), conv, turn):
                        votes[level, s] += 1
                        single += 1
        best = max(votes, key=lambda v: (-v[0], votes[v], v[1][0] == conv, v[1][1], -v[1][0]), default=None)
        found[m] = [sum(level > 0 for level, _ in lines), passages, single, best and best[1]]
    out = {}
    for conv in {m[0] for m in rows}:
        mine = [m for m in rows if m[0] == conv]
        opens = {}
        for m in mine:
            reply = found[m][3]
            if reply and reply[0] == conv and conv is not None:
                opens[m[1]] = max(opens.get(m[1], -1), reply[1])
        threads = {m: max(((t, p) for t, p in opens.items() if m[1] is not None and t <= m[1]), default=None) for m in mine}
        none_first = lambda x: (x is not None, x or 0)
        key = lambda m: __import__("hashlib").md5("\x01".join(x for x in m[2:] if x is not None).encode()).hexdigest()
        order = sorted(mine, key=lambda m: (none_first(threads[m] and threads[m][1]), none_first(threads[m] and threads[m][0]), none_first(m[1]), key(m)))
        for position, m in enumerate(order, 1):
            out[m] = (*found[m][:3], found[m][3], threads[m], position)
    return out


def test_quotations_equal_brute_force(spark):
    """Hundreds of messages with nested quotes, whole and in part, of their own and of other conversations, with ties and repeated lines."""
    rng = np.random.default_rng(8)
    stock = [f"line {i} of the stock" for i in range(25)] + ["ok", "Thanks", "see below"]
    messages, history = [], []
    for _ in range(400):
        conv, turn = int(rng.integers(0, 30)), int(rng.integers(0, 12))
        text = []
        for _ in range(rng.integers(0, 3)):
            if history:
                source = history[rng.integers(len(history))].split("\n")
                lo = int(rng.integers(0, 2)) if rng.random() < 0.4 else 0
                depth = "> " * int(rng.integers(1, 3))
                text += [depth + x for x in source[lo:]] + ([""] if rng.random() < 0.3 else [])
                if rng.random() < 0.3:
                    text.append(depth + "an altered line")
        text += [str(stock[i]) for i in rng.integers(0, len(stock), rng.integers(0, 5))]
        history.append("\n".join(text))
        messages.append((conv, turn, str(rng.choice(["user", "bot"])), history[-1]))
    messages += [messages[0], messages[1], (None, 3, "user", "> ok"), (4, None, "user", "> ok\n> Thanks"), (5, 1, "user", None), (6, 2, None, "> line 1 of the stock")]
    messages += [(77, t, "user", f"message {t}\n> message {max(0, t - 3)}") for t in range(700)]
    expected = brute_quotes(messages)
    got = reply_ordered(spark.createDataFrame(messages, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert len(got) == len(expected)
    plain_found = sorted(repr((r.conv_id, r.turn, r.role, r.n_quoted, r.n_passages, r.n_lines, (r.reply_conv, r.reply_turn) if r.reply_turn is not None else None, (r.thread_start, r.thread_parent) if r.thread_start is not None else None, r.position)) for r in got)
    plain_expected = sorted(repr((m[0], m[1], m[2], *v)) for m, v in expected.items())
    assert plain_found == plain_expected
    assert sum(r.n_passages for r in got) > 300 and sum(r.n_lines for r in got) > 50 and sum(r.max_level > 1 for r in got) > 50

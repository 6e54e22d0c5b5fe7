from lectern.plans.store import VersionedTable
from lectern.streaming.soft_ingest import Step, keep_ingested, outcomes, run_steps


def failing(on, value):
    def run(row):
        if row["n"] % 7 == on:
            raise ValueError(f"no {value} for {row['n']}")
        return value

    return run


def steps(broken=True):
    at = (lambda k: k) if broken else (lambda k: -1)
    return [
        Step("embedded", failing(at(0), [1.0, 2.0]), "array<double>"), Step("analyzed", failing(at(1), "summary"), "string"), Step("content", failing(at(2), 3), "int", ("embedded", "analyzed")),
        Step("coupled", failing(at(3), 4), "bigint", ("analyzed",)), Step("graph", failing(at(4), True), "boolean"), Step("archived", failing(at(5), "page"), "string"),
    ]


def test_each_step_fails_on_some_rows(spark):
    rows = spark.createDataFrame([(f"h{n}", n, None if n == 6 else "t") for n in range(21)], "sha256 string, n int, text string").repartition(3)
    got = {r.n: r for r in run_steps(rows, steps()).collect()}
    assert len(got) == 21
    for n, r in got.items():
        k = n % 7
        want = {"embedded": k != 0, "analyzed": k != 1, "content": k not in (0, 1, 2), "coupled": k not in (1, 3), "graph": k != 4, "archived": k != 5}
        assert {s: r[s] is not None for s in want} == want
        names = {0: ["embedded"], 1: ["analyzed"], 2: ["content"], 3: ["coupled"], 4: ["graph"], 5: ["archived"], 6: []}[k]
        assert [w.split(" failed: ")[0] for w in r.warnings] == names and all(w.endswith(f"for {n}") for w in r.warnings)
    assert {tuple(x) for x in outcomes(run_steps(rows, steps()), steps()).collect()} == {("embedded", 18, 3, 0), ("analyzed", 18, 3, 0), ("content", 12, 3, 6), ("coupled", 15, 3, 3), ("graph", 18, 3, 0), ("archived", 18, 3, 0)}
    assert got[8].text == "t" and got[6].text is None and run_steps(rows.limit(0), steps()).count() == 0


def test_skip_retry_and_force(spark, tmp_path):
    kind, source = "sha256 string, n int", str(tmp_path / "in")
    store = VersionedTable(spark, str(tmp_path / "store"), ["sha256"])
    write = lambda ns: spark.createDataFrame([(f"h{n}", n) for n in ns], kind).coalesce(1).write.mode("append").parquet(source)
    run = lambda own, force=False: keep_ingested(spark.readStream.schema(kind).parquet(source), store, own, str(tmp_path / "check"), force).awaitTermination()
    written = lambda: {r.n for r in spark.read.parquet(f"{store.root}/v{store.versions()[-1]}/rows").collect()}
    write(range(7))
    run(steps())
    assert store.read().filter("size(warnings) > 0").count() == 6
    write([*range(9), 8])
    run(steps(broken=False))  # 6 was whole; the others get what they lacked; 7 and 8 are new
    assert written() == {0, 1, 2, 3, 4, 5, 7, 8} and store.read().count() == 9 and store.read().filter("size(warnings) > 0").count() == 0
    write([6])
    run(steps(broken=False))
    assert written() == set()
    write([6])
    run([Step("embedded", lambda row: [9.0], "array<double>"), *steps(broken=False)[1:]], force=True)
    assert written() == {6} and {tuple(r.embedded) for r in store.read().filter("n = 6").collect()} == {(9.0,)}

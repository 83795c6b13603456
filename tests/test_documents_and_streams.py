import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weftgraph.sources import documents, schemas
from weftgraph.streaming import incremental
from weftgraph.streaming.incremental import Generations

U1, U2 = "11111111-1111-5111-8111-111111111111", "22222222-2222-5222-8222-222222222222"


def block(u, body):
    return f"<!-- kg:uuid={u} -->\n{body}\n<!-- /kg -->"


def test_scan_gives_every_file_a_disposition(spark, tmp_path):
    for path, content in {"a/SKILL.md": b"---\nname: one\ndomain: d\n---\ntext", "a/references/x.md": b"Title line\nkey: v", "a/b/SKILL.md": b"---\nname: two\n---\nk: v\nFirst\n", "a/b/y.md": b"ok", "bad.md": b"\xff\xfe", "nul.md": b"a\x00", "other.txt": b"x", "skip.md": b"x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    got = {r.path: (r.disposition, r.skill) for r in documents.scan(spark, str(tmp_path), ignore=("skip*",)).collect()}
    assert got == {"a/SKILL.md": ("supported", "a"), "a/references/x.md": ("supported", "a"), "a/b/SKILL.md": ("supported", "a/b"), "a/b/y.md": ("supported", "a/b"), "bad.md": ("unsupported", None), "nul.md": ("unsupported", None), "other.txt": ("unsupported", None), "skip.md": ("excluded", None)}
    fm = documents.front_matter(F.col("text"))
    text = documents.scan(spark, str(tmp_path)).where("path in ('a/SKILL.md', 'a/b/SKILL.md')").select("path", fm["name"], fm["hint"])
    assert rows(text) == [("a/SKILL.md", "one", "d"), ("a/b/SKILL.md", "two", "First")]


def test_blocks_and_edits(spark):
    text = "intro\n" + block(U1, "one\n") + "\n" + block(U1, "again") + "\n<!-- /kg -->\n" + block(U2, f"<!-- kg:uuid={U1} -->\nx") + "\n<!-- kg: broken\n<!-- kg:uuid=" + U2 + " -->\nrest"
    kinds = [p[0] for p in documents.parse_blocks(text)]
    assert kinds == ["outside", "block", "duplicate", "block", "orphan_close", "nested", "block", "malformed", "outside", "duplicate", "unclosed"]
    docs = spark.createDataFrame([("d1", block(U1, "body  \n") + "\nnew text"), ("d2", "nothing"), ("d3", None)], "p string, t string")
    parsed = documents.blocks(docs, "p", "t")
    base = spark.createDataFrame([("d1", U1, "body"), ("d2", U2, "gone")], "path string, uuid string, body string").withColumn("editable_hash", documents.editable_hash(F.col("body")))
    assert rows(documents.classify_edits(parsed, base).select("path", "change")) == [("d1", "C4"), ("d2", "C2"), ("d2", "C4")]
    moved = parsed.where("kind = 'block'").select(F.lit("d9").alias("path"), "uuid", documents.editable_hash(F.col("body")).alias("editable_hash"))
    assert rows(documents.planned_moves(base.select("path", "uuid", "editable_hash"), moved)) == [("d1", "d9", "move")]


def test_char_windows_cover_the_text(spark):
    text = "".join(f"line {i}\n" for i in range(900))
    got = documents.char_chunks(spark.createDataFrame([("k", text), ("e", "")], "k string, t string"), "k", "t").orderBy("start_char").collect()
    assert got[0].start_char == 0 and got[-1].end_char == len(text)
    for r in got:
        assert text[r.start_char : r.end_char] == r.text and r.start_line == 1 + text.count("\n", 0, r.start_char)
    windows = documents.token_windows(spark.createDataFrame([("k", " ".join(map(str, range(600))))], "k string, t string"), "k", "t").orderBy("first_token").collect()
    assert [(w.first_token, w.n_tokens) for w in windows] == [(0, 256), (224, 256), (448, 152)]


def test_contract(spark):
    good = spark.createDataFrame([], schemas.CROSS_REFERENCES)
    assert schemas.violations(good, schemas.CROSS_REFERENCES) == []
    assert schemas.violations(good.drop("kind").withColumn("id", F.lit("x")), schemas.CROSS_REFERENCES) == ["id is string, not bigint", "kind is missing"]
    assert schemas.with_missing(good.drop("kind"), schemas.CROSS_REFERENCES).columns[-1] == "kind"


def test_generations_are_published_once(spark, tmp_path):
    src = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([(k, f"d{k}"), (9, f"v{k}")], "id int, text string").coalesce(1).write.parquet(str(src / f"part{k}"))
    gens = incremental.Generations(spark, str(tmp_path / "kb"))

    def step(old, new):
        both = new if old is None else old.join(new.select("id"), "id", "left_anti").unionByName(new)
        return both.groupBy("id").agg(F.max("text").alias("text"))

    stream = incremental.files(spark, str(src) + "/*", "id int, text string", per_trigger=1)
    incremental.run(stream, gens, step, str(tmp_path / "cp")).awaitTermination()
    assert rows(gens.read().select("id"))[:3] == [(0,), (1,), (2,)] and gens.read().count() == 4
    before = gens.current()
    assert gens.publish(gens.read(), before["batch"]) == before["generation"]  # a batch that comes again changes nothing
    incremental.run(stream, gens, step, str(tmp_path / "cp")).awaitTermination()
    assert gens.current() == before


def test_deliveries_windows_and_leases(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("select * from values ('a', timestamp'2025-01-01 10:05:00', 1.0D), ('a', timestamp'2025-01-01 10:06:00', 2.0D), ('b', timestamp'2025-01-01 10:07:00', 4.0D), ('c', timestamp'2025-01-03 00:00:00', 1.0D) as t(id, ts, v)").write.parquet(src)
    stream = lambda: incremental.files(spark, src, "id string, ts timestamp, v double")
    for name, df, mode in (("once", incremental.once_per_delivery(stream(), "id", "ts"), "append"), ("win", incremental.windowed(stream(), "ts", "id", "v"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert rows(spark.table("once").select("id")) == [("a",), ("b",), ("c",)]
    assert rows(spark.table("win").select("id", "n", "total")) == [("a", 2, 3.0), ("b", 1, 4.0), ("c", 1, 1.0)]

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    asks = pd.DataFrame([("r", "x", "acquire", 0, 10), ("r", "y", "acquire", 5, 10), ("r", "x", "renew", 9, 10), ("r", "x", "renew", 30, 10), ("r", "y", "acquire", 31, 10), ("r", "y", "release", 32, 0), ("r", "x", "acquire", 33, 5)], columns=["resource", "holder", "action", "at", "ttl"])
    out = next(incremental.lease(("r",), iter([asks]), State()))
    assert out.granted.tolist() == [True, False, True, False, True, True, True]
    log = spark.createDataFrame([("r", "Idle", 1), ("r", "FetchSource", 2), ("r", "FetchSource", 3), ("r", "Plan", 4), ("r", "UploadCandidate", 5), ("s", "Stable", 1), ("s", "Idle", 2)], "run string, state string, at int")
    assert rows(incremental.illegal_transitions(log, "run", "state", "at").select("before", "after")) == [("Plan", "UploadCandidate"), ("Stable", "Idle")]
    assert len(set(incremental.STATES)) == 20


def test_a_run_that_breaks_off_keeps_the_last_generation(spark, tmp_path):
    folder = f"file://{tmp_path}/gens"
    g = Generations(spark, folder)
    assert g.current() is None
    assert g.publish(spark.range(3), 0, "a") == 0 and g.publish(spark.range(4), 1, "b") == 1
    (tmp_path / "gens" / ".CURRENT-2.x").write_text("{")  # stopped before the rename
    (tmp_path / "gens" / "gen=2").mkdir()
    again = Generations(spark, folder)
    assert again.current()["generation"] == 1 and again.read().count() == 4
    assert again.publish(spark.range(5), 2, "c") == 2 and again.read().count() == 5
    assert again.publish(spark.range(9), 1, "b") == 2 and again.read().count() == 5  # a repeated batch changes nothing
    with pytest.raises(ValueError):
        again.publish(spark.range(9), 2, "other")


def test_an_invalid_generation_is_not_published(spark, tmp_path):
    def check(df):
        if df.count() < 2:
            raise ValueError("too few rows")

    g = Generations(spark, f"file://{tmp_path}/gens", check)
    g.publish(spark.range(3), 0)
    with pytest.raises(ValueError):
        g.publish(spark.range(1), 1)
    assert g.current()["generation"] == 0 and g.read().count() == 3

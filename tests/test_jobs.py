import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import oracle
from jobs import collection_report, detect_arrivals
from jobs import queries as J
from jobs.common import defaults, settings

ROOT = Path(__file__).parents[1]


@pytest.mark.parametrize("name", sorted(J.QUERIES))
def test_against_sql(spark, small, name):
    got, want = oracle.both(spark, small, J.QUERIES[name], J.ORACLE_SQL[name])
    assert got == want


def arrive(df, folder, name):
    """A file of a growing table, written aside and moved in, as arriving files are."""
    aside = f"{folder}/.aside"
    df.coalesce(1).write.mode("overwrite").parquet(aside)
    Path(f"{folder}/embeddings.parquet").mkdir(parents=True, exist_ok=True)
    next(Path(aside).glob("part-*")).rename(f"{folder}/embeddings.parquet/{name}.parquet")


def rows(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


@pytest.fixture
def arrivals(spark, small, tmp_path):
    table = spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id < 200")
    s = defaults(detect_arrivals.__file__)
    runs = []

    def take():
        out = f"{tmp_path}/out"
        runs.append(detect_arrivals.run(spark, str(tmp_path), out, f"{tmp_path}/checkpoint", s))
        return rows(detect_arrivals.read_output(spark, out))

    return table, str(tmp_path), s, take, runs


def whole(spark, table, folder, s):
    """The same objects from all rows at once."""
    arrive(table, f"{folder}/all", "one")
    detect_arrivals.run(spark, f"{folder}/all", f"{folder}/all/out", f"{folder}/all/checkpoint", s)
    return rows(detect_arrivals.read_output(spark, f"{folder}/all/out"))


def test_growing_input_gives_what_all_of_it_gives(spark, arrivals):
    table, folder, s, take, runs = arrivals
    first, rest = table.where("vec_id % 3 = 0 and vec_id < 100"), table.where("not (vec_id % 3 = 0 and vec_id < 100)")
    arrive(first, folder, "a")
    seen = take()
    assert seen == whole(spark, first, folder + "/1", s)
    assert take() == seen and runs == [2, 0]  # nothing new: nothing changes
    arrive(rest.where("vec_id >= 128"), folder, "b")
    arrive(rest.where("vec_id < 128"), folder, "c")
    assert take() == whole(spark, table, folder + "/2", s)
    assert runs[2] == 4


def test_a_chunk_that_comes_again_takes_the_place_of_the_old_one(spark, arrivals):
    table, folder, s, take, _ = arrivals
    arrive(table, folder, "a")
    take()
    blank = table.where("vec_id in (3, 70)").withColumn("embedding", F.transform("embedding", lambda e: F.lit(-1.0).cast("float")))
    arrive(blank, folder, "b")
    want = whole(spark, table.where("vec_id not in (3, 70)").unionByName(blank), folder + "/1", s)
    assert take() == want and {3, 70} & {r[table_label] // 33 for r in want} == set()


table_label = sorted("layer cz cy cx label z y x count volume sum_intensity layer_chunks layer_objects layer_volume".split()).index("label")


def test_the_newest_of_several_files_in_one_batch(spark, arrivals):
    import os

    table, folder, s, take, _ = arrivals
    other = table.where("vec_id < 20").withColumn("embedding", F.transform("embedding", lambda e: -e))
    arrive(table, folder, "b")
    arrive(other, folder, "a")
    os.utime(f"{folder}/embeddings.parquet/b.parquet", (1_000_000, 1_000_000))
    assert take() == whole(spark, table.where("vec_id >= 20").unionByName(other), folder + "/1", s)


@pytest.mark.parametrize("where", ["detect", "update_totals"])
def test_a_run_that_broke_off_is_made_up_for(spark, arrivals, monkeypatch, where):
    table, folder, s, take, _ = arrivals
    arrive(table.where("vec_id < 90"), folder, "a")
    take()
    arrive(table.where("vec_id >= 90"), folder, "b")
    work = getattr(detect_arrivals, where)

    def broken(*a):
        if where == "detect":
            work(*a)  # all is written, but the batch is not marked as done
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(detect_arrivals, where, broken)
        with pytest.raises(Exception, match="stopped"):
            take()
    assert take() == whole(spark, table, folder + "/1", s)


def test_bad_chunks_and_settings(spark, arrivals):
    table, folder, s, take, _ = arrivals
    arrive(table.limit(5).unionByName(table.limit(1).withColumn("vec_id", F.lit(None).cast("long"))), folder, "a")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    assert take()
    assert spark.conf.get(key, None) == before
    short = table.limit(1).selectExpr("vec_id", "slice(embedding, 1, 5) AS embedding", "label")
    arrive(short, folder, "b")
    with pytest.raises(Exception, match="does not hold 64 values"):
        take()
    with pytest.raises(ValueError, match="unknown settings: nonsense"):
        Path(f"{folder}/s.yaml").write_text("nonsense: 1\n")
        settings(spark, detect_arrivals.__file__, f"{folder}/s.yaml")
    Path(f"{folder}/s.yaml").write_text("foreground: 5\n")
    assert settings(spark, detect_arrivals.__file__, f"{folder}/s.yaml") == s | {"foreground": 5}


TEXTS = [(1, "one two", "en", "a"), (2, "three", "de", "a"), (3, None, "en", "a"), (4, "x y z", None, "b"), (5, "", "en", "b"), (6, "four five six", "en", "b"), (7, "seven", "en", None), (None, "eight", "de", "a"), (2, "three", "de", "a"), (8, "nine", "fr", "c")]


@pytest.fixture
def texts(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string")
    docs.withColumn("n_chars", F.lit(0)).withColumn("reason", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (1, 0), (2, 0), (6, None), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_report_of_texts(spark, texts):
    s = defaults(collection_report.__file__)
    want = {"read": 10, "unplaced": 5, "specimens": 2, "report": 14, "quarantine": 5}
    for _ in range(2):
        assert collection_report.run(spark, texts, f"{texts}/out", s) == want
        got = {(r["specimen"], r["region"]): (r["parent"], r["count"], r["volume"], r["sum_intensity"]) for r in collection_report.read_output(spark, f"{texts}/out").collect()}
        assert got["a", "all"] == (None, 3, 4, 17) and got["a", "en/good"] == ("en", 1, 2, 7) and got["a", "de/poor"] == ("de", 2, 2, 10)
        assert got["a", "fr"] == ("all", 0, 0, 0) and got["c", "fr/unmarked"] == ("fr", 1, 1, 4)
        assert got["b", None] == got["unassigned", None] == (None, None, None, None)  # set aside: two of three objects, and the only one
        bad = {(r["object"], r["reason"]) for r in spark.read.parquet(f"{texts}/out/quarantine").collect()}
        assert bad == {(3, "no text"), (4, "no region"), (5, "no text"), (7, "no specimen"), (None, "no id")}
    kept = s | {"most_unplaced": 0.7}
    assert collection_report.run(spark, texts, f"{texts}/out", kept)["specimens"] == 3
    assert {(r["specimen"], r["count"]) for r in collection_report.read_output(spark, f"{texts}/out").where("region = 'en'").collect()} == {("a", 1), ("b", 1), ("c", 0)}


def test_report_of_nothing(spark, texts):
    spark.read.parquet(f"{texts}/documents.parquet").limit(0).write.parquet(f"{texts}/none/documents.parquet")
    spark.read.parquet(f"{texts}/labels.parquet").write.parquet(f"{texts}/none/labels.parquet")
    done = collection_report.run(spark, f"{texts}/none", f"{texts}/none/out", defaults(collection_report.__file__))
    assert done == {"read": 0, "unplaced": 0, "specimens": 0, "report": 0, "quarantine": 0}
    assert collection_report.read_output(spark, f"{texts}/none/out").count() == 0


@pytest.mark.parametrize("job, extra", [("detect_arrivals", ["--checkpoint", "checkpoint"]), ("collection_report", [])])
def test_command_line(spark, small, tmp_path, job, extra):
    extra = [f"{tmp_path}/{x}" if not x.startswith("--") else x for x in extra]
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--input", small, "--output", f"{tmp_path}/out", *extra], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr and list(Path(f"{tmp_path}/out").rglob("*.parquet"))

"""A folder of want-lists as a stream: new files only, and a batch that is run again changes nothing."""

from tonearm.streaming.progress import acquire_stream

HEAD = "Artist,Title,Album,Length,Year,Source,SourceUrl\n"


def test_new_files_become_plans(spark, tmp_path):
    lists, out, state = (str(tmp_path / d) for d in ("lists", "out", "state"))
    (tmp_path / "lists").mkdir()
    library = spark.createDataFrame([("b - two",)], "key string")

    def run():
        acquire_stream(spark, lists, library, out, state).awaitTermination()
        return sorted((r.Artist, r.Title, r.action, r.batch) for r in spark.read.parquet(out).collect())

    (tmp_path / "lists" / "1.csv").write_text(HEAD + 'A,One,,,,first,u\nB,Two,,,,s,u\na,"one",,,,again,u\n')
    first = run()
    assert first == [("A", "One", "WORK", 0), ("B", "Two", "DUPLICATE", 0)]
    assert {r.Source for r in spark.read.parquet(out).where("Artist = 'A'").collect()} == {"first"}
    assert run() == first
    (tmp_path / "lists" / "2.csv").write_text(HEAD + "C,Three,,,,s,u\n")
    assert run() == [*first, ("C", "Three", "WORK", 1)]


def test_a_library_that_grows_and_a_killed_run(spark, tmp_path, monkeypatch):
    """What an earlier batch planned is known to later ones; a batch that broke off is run again and changes nothing; the same as all at once."""
    from tonearm.plans import flows
    from tonearm.streaming import progress

    lists, out, state = (str(tmp_path / d) for d in ("lists", "out", "state"))
    (tmp_path / "lists").mkdir()
    library = spark.createDataFrame([("b - two",)], "key string")
    files = {"1.csv": "A,One,,,,s,u\nB,Two,,,,s,u\n", "2.csv": "a,ONE,,,,s,u\nC,Three,,,,s,u\n", "3.csv": "C,Three,,,,s,u\nD,Four,,,,s,u\nA,One,,,,s,u\n"}

    def run():
        acquire_stream(spark, lists, library, out, state).awaitTermination()

    for name, body in files.items():
        (tmp_path / "lists" / name).write_text(HEAD + body)
        if name == "2.csv":  # the plan is written, then the run dies before the batch is committed

            def dies(rows, known):
                made = flows.acquire(rows, known)
                made.write.mode("overwrite").parquet(f"{out}/batch=1")
                raise RuntimeError("killed")

            monkeypatch.setattr(progress, "acquire", dies)
            try:
                run()
            except Exception as e:
                assert "killed" in str(e)
            monkeypatch.setattr(progress, "acquire", flows.acquire)
        run()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.key, r.action) for r in rows if r.action == "WORK") == [("a - one", "WORK"), ("c - three", "WORK"), ("d - four", "WORK")]
    every = spark.read.schema("Artist string, Title string, Album string, Length string, Year string, Source string, SourceUrl string").csv(lists, header=True)
    from pyspark.sql import functions as F

    once = flows.acquire(every.withColumn("row", F.monotonically_increasing_id()), library).where("action = 'WORK'")
    assert {r.key for r in once.collect()} == {r.key for r in rows if r.action == "WORK"}
    first = next(r for r in rows if r.key == "c - three" and r.action == "WORK")
    assert first.batch == 1

import hashlib

import pytest
from pyspark.sql import functions as F

from residua.sources import fasta, tables
from residua.functions import sql as session_sql
from residua.functions.features import feature_columns
from residua.streaming import screening, states


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one first > record\nac-de\nFG\n>two\r\nKKK\n\n>three\n")
    rows = fasta.read_fasta(spark, str(tmp_path / "a.fasta")).orderBy("ordinal").collect()
    assert [(r.record_id, r.description, r.sequence) for r in rows] == [("one", "one first > record", "ACDEFG"), ("two", "two", "KKK"), ("three", "three", "")]
    fasta.write_fasta(spark.createDataFrame([("x", None, "A" * 70)], "record_id string, description string, sequence string"), str(tmp_path / "out"))
    assert fasta.read_fasta(spark, str(tmp_path / "out")).first().sequence == "A" * 70
    (tmp_path / "empty.fasta").write_text("nothing here\n")
    with pytest.raises(ValueError):
        fasta.read_fasta(spark, str(tmp_path / "empty.fasta"))


def test_fasta_in_many_splits_and_files(spark, tmp_path):
    """No record is lost where a file is cut, and no preamble is kept where files share a partition."""
    whole = [(f"id{i}", f"id{i} of {i % 7}", "ACDEFGHIKL" * (1 + i % 9)) for i in range(1000)]
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.fasta").write_text("a preamble\nof two lines\n" + "".join(f">{d}\n{s}\n" for _, d, s in whole[:600]))
    (tmp_path / "many" / "b.fasta").write_text("junk\n" + "".join(f">{d}\n{s}\n" for _, d, s in whole[600:999]))
    (tmp_path / "many" / "c.fasta").write_text(f">{whole[999][1]}\n{whole[999][2]}")
    (tmp_path / "many" / "d.fasta").write_text("only junk\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2000", "777", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = fasta.read_fasta(spark, str(tmp_path / "many"))
            assert sorted((r.record_id, r.description, r.sequence) for r in rows.collect()) == sorted(whole)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_download_and_discovery(spark, tmp_path):
    data = tables.write_downloaded_fasta(spark, ["junk", ">a", "AC ", ">b", "D", ">c"], str(tmp_path / "d.fasta"), "s", "u", "q", 2)
    text = ">a\nAC\n>b\nD\n"
    assert (data["records"], data["sha256"], data["query"]) == (2, hashlib.sha256(text.encode()).hexdigest(), "q")
    assert "".join(r[0] + "\n" for r in spark.read.text(str(tmp_path / "d.fasta")).collect()) == text
    assert tables.file_sha256(spark, str(tmp_path / "d.fasta")).first().sha256 == data["sha256"]
    assert fasta.read_fasta(spark, str(tmp_path / "d.fasta")).count() == 2
    with pytest.raises(RuntimeError):
        tables.write_downloaded_fasta(spark, ["junk"], str(tmp_path / "e"), "s", "u", "q")
    with pytest.raises(ValueError):
        tables.write_downloaded_fasta(spark, [">a"], str(tmp_path / "e"), "s", "u", "q", 0)
    for name, more in (("m1", '"model_name": "One"'), ("m2", '"scientific_status": "synthetic_ui_demo_only"'), ("m3", '"x": 1')):
        spark.createDataFrame([(f'{{"threshold": 0.5, "version": 1, {more}}}',)], "value string").coalesce(1).write.text(str(tmp_path / name / "metadata"))
    found = tables.discover_models(spark, [str(tmp_path / n) for n in ("m1", "none", "m2", "m3")])
    assert {k: v[0].rsplit("/", 1)[1] for k, v in found.items()} == {"One": "m1", "Toy UI model — synthetic data": "m2", "m3": "m3"}


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("ACDEF", "x")], "sequence string, other string")
    tables.write_csv(df, str(tmp_path / "c"), one_file=True)
    assert tables.read_batch_csv(spark, str(tmp_path / "c")).collect() == df.collect()
    with pytest.raises(ValueError):
        tables.read_batch_csv(spark, str(tmp_path / "c"), 0)
    tables.write_json(spark, {"b": 1, "a": [2]}, str(tmp_path / "j"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "j")).collect()] == ["{", '  "a": [', "    2", "  ],", '  "b": 1', "}"]
    (tmp_path / "f").write_bytes(b"abc")
    assert tables.file_sha256(spark, str(tmp_path / "f")).first().sha256 == hashlib.sha256(b"abc").hexdigest()
    assert tables.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "f")]) == str(tmp_path / "f")
    bundle = spark.createDataFrame([("A", 1, "train", "g", [1.0, 2.0])], "sequence string, label int, split string, split_group string, embedding array<double>")
    tables.write_bundle(bundle, str(tmp_path / "b"), "m")
    assert tables.read_bundle(spark, str(tmp_path / "b")).first().embedding == [1.0, 2.0]
    assert list(tables.parse_downloaded_fasta(["junk", ">a", "A", ">b", "C", ">c"], 2)) == [">a", "A", ">b", "C"]


def test_stream_screens_as_a_batch_does(spark, tmp_path):
    spark.createDataFrame([("KWKLFKKIGAVLKVL",), ("X",), ("DDDDDD",)], "sequence string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sequence string").parquet(str(tmp_path / "in"))
    out = screening.screen_stream(stream, 1 / (1 + F.exp(-F.col("net_charge_pH7"))), 0.5).select("sequence", "score", "interpretation")
    screening.run_available(out, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert {r.sequence: r.interpretation for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"KWKLFKKIGAVLKVL": "AMP-like", "DDDDDD": "Non-AMP-like"}


def test_states_survive_restarts_and_replays(spark, tmp_path):
    kind = "sequence string, label int, source_id string"
    batches = [[("AC", 1, "b"), ("AC", 1, "c"), ("DE", 0, "d")], [("AC", 0, "a"), (None, 1, "n"), ("FG", None, "z")], [("DE", 0, "d"), (None, None, "m")]]
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        states.run_states(states.sequence_states(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {r.sequence: tuple(r)[1:] for r in states.latest_states(spark, str(tmp_path / "out")).collect()}
    assert got == {"AC": ("a", 3, 2, 2), "DE": ("d", 2, 1, 1), "FG": ("z", 1, 0, 0), None: ("m", 2, 1, 1)}
    assert [r.sequence for r in states.conflicting(states.latest_states(spark, str(tmp_path / "out"))).collect()] == ["AC"]


def test_functions_in_sql(spark):
    session_sql.register(spark)
    spark.createDataFrame([("KWKLFKKIGAVLKVL",), (None,)], "s string").createOrReplaceTempView("some_peptides")
    made = feature_columns(F.col("s"), ("gravy", "net_charge_pH7", "hydrophobic_moment", "instability_index", "molecular_weight", "shannon_entropy"))
    want = spark.table("some_peptides").filter("s is not null").select(*(c.alias(n) for n, c in made.items())).first()
    got = spark.sql("SELECT screen_gravy(s) g, screen_charge(s, 7D) c, screen_moment(s) m, screen_instability(s) i, screen_weight(s) w, screen_entropy(s) e FROM some_peptides WHERE s IS NOT NULL").first()
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))
    assert tuple(spark.sql("SELECT screen_gravy(s), screen_parent(s), screen_sha256(s) FROM some_peptides WHERE s IS NULL").first()) == (None, None, None)
    assert [tuple(r) for r in spark.sql("SELECT screen_parent('ac d-E'), screen_parent('acx!')").collect()] == [("ACDE", "")]
    assert spark.sql("SELECT a.check FROM some_peptides p, LATERAL screen_audit(p.s, 5, 10) a WHERE a.status = 'Outside model range'").count() == 1
    assert spark.sql("SELECT a.status FROM some_peptides p, LATERAL screen_audit(p.s, 5, 10) a WHERE p.s IS NULL AND a.status IS NULL").count() == 4


def test_audits_of_whole_tables_join_and_shuffle_nothing(spark, tmp_path):
    from residua.plans import catalogue

    rows = [(7, "a", "ACDEFGHIKLMNPQRSTVWY" * 3), (8, "a", "GGGGGGGGGGGGGG"), (9, "b", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    long = catalogue.sql_audit(spark, str(tmp_path))
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert "Generate explode" not in catalogue.sequence_audit(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in long.collect():
        found.setdefault(r.source_id, {})[r.check] = r.status
    wide = {r.source_id: (r.length_domain, r.complexity, r.hydrophobic, r.charge) for r in catalogue.sequence_audit(spark, str(tmp_path)).collect()}
    assert wide == {k: tuple(v.values()) for k, v in found.items()} and len(wide) == 5


def test_features_read_letters_by_place(spark):
    from residua.functions import constants as K
    from residua.functions.features import hydrophobic_moment, instability_index

    df = spark.createDataFrame([("ACDEFGHIKLMNPQRSTVWYWWCKRRAD",), ("A",), ("AaC\u00e9D",)], "s string")
    got = df.select("s", hydrophobic_moment(F.col("s")).alias("m"), instability_index(F.col("s")).alias("i"))
    assert "try_element_at" not in got._jdf.queryExecution().optimizedPlan().toString()
    for r in got.collect():
        want = 10 / len(r.s) * sum(K.INSTABILITY.get(a, {}).get(b, 1.0) for a, b in zip(r.s, r.s[1:])) if len(r.s) > 1 else 0.0
        assert abs(r.i - want) < 1e-9 and (r.m is None) == (r.s == "AaC\u00e9D")


def test_audit_decides_entropies_at_the_limit_as_its_sql(spark, tmp_path):
    import duckdb

    from residua.plans import catalogue

    # Each peptide of 48 residues has 2.5 bits exactly, and of 24 residues too.
    rows = [(38, "a", "SLYNNERE" * 6), (78, "a", "ACHSCHNG" * 6), (14, "b", "AAAAAAAAACCCCDDDEEEFFGGH"), (54, "b", "HGGFFEEEDDDCCCCAAAAAAAAA"), (15, "c", "KWKLFKKIGAVLKVL")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made = catalogue.sql_audit(spark, str(tmp_path))
    assert "size(" not in made._jdf.queryExecution().executedPlan().toString()  # no filter that makes the checks once more
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.execute(catalogue.ORACLES["sql_audit"]).fetchall()
    got = sorted(tuple(r) for r in made.collect())
    assert got == sorted(want) and ("38:0", "Sequence complexity", "No strong flag") in got
    one = spark.sql(f"SELECT screen_entropy('{'ACHSCHNG' * 12}') AS long, screen_entropy('') AS none, screen_entropy(NULL) AS missing").first()
    assert one.long == 2.5 and one.missing is None

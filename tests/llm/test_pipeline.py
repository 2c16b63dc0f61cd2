"""The pipeline's stages on a small corpus, against what each must keep."""

import random

import corpus_pipeline
from residua.llm.simhash import simhash


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(1)
    words = [a + b for a in ("ba", "to", "ki", "re", "su", "na") for b in ("n", "la", "mi", "sto", "ger", "")]

    def prose(n):
        return "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(n))

    item = " ".join(f"{rng.choice(words)}{rng.randrange(90)}" for _ in range(40))
    rows = [(i, prose(8) + "\nsubscribe now\n" + prose(4)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    rows += [(200 + i, prose(4) + " " + item + " " + prose(4)) for i in range(5)]
    rows += [(300 + i, "!! ".join(rng.choice(words).upper() for _ in range(80))) for i in range(20)]
    rows += [(400, None), (401, "")]
    # Near copies: every 60th word of a long text edited, which leaves about 0.84 of the five-word shingles; and a far one, every 15th.
    long = [[rng.choice(words) for _ in range(600)] for _ in range(40)]
    rows += [(500 + i, " ".join(t)) for i, t in enumerate(long)]
    rows += [(600 + i, " ".join(rng.choice(words) + "x" if k % 60 == i else w for k, w in enumerate(t))) for i, t in enumerate(long)]
    rows += [(700 + i, " ".join(rng.choice(words) + "y" if k % 15 == i % 15 else w for k, w in enumerate(t))) for i, t in enumerate(long)]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(300 + i, 0, 0) for i in range(0, 20, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {}
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert now.columns == docs.columns
        kept[name] = {r.doc_id: r for r in now.collect()}
    assert not any(300 <= i < 400 for i in kept["quality"]) and set(range(60)) <= set(kept["quality"])
    assert all("subscribe" not in (r.text or "") for r in kept["lines"].values()) and set(kept["lines"]) == set(kept["quality"])
    assert all(r.n_chars == len(r.text) for i, r in kept["lines"].items() if i < 60)
    assert not any(100 <= i < 110 for i in kept["near_duplicates"]) and set(range(60)) <= set(kept["near_duplicates"])
    fps = [simhash((r.text or "").encode()) for r in kept["near_duplicates"].values()]
    assert all((a ^ b).bit_count() > 3 for k, a in enumerate(fps) for b in fps[:k])
    assert not any(600 <= i < 700 for i in kept["near_duplicates"]) and {*range(500, 540), *range(700, 740)} <= set(kept["near_duplicates"])
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for r in kept["near_duplicates"].values() if (w := (r.text or "").lower().split())]
    assert all(len(a & b) < 0.8 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    assert set(kept["decontamination"]) == {i for i in kept["near_duplicates"] if not 200 <= i < 300}
    whole = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in now.collect()}
    assert {x[0] for x in whole} == set(kept["decontamination"])


def test_null_and_repeated_ids(spark, tmp_path):
    """A verdict is a row's own: null ids are judged, and rows that share an id with a dropped one stay."""
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("lo", "mi", "ru", "za") for b in range(60)]
    prose = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(8)]
    item = " ".join(rng.choice(words) + "q" for _ in range(40))
    held = prose[0] + " " + item + " " + prose[1]
    near = prose[2].replace(prose[2].split()[60], "changed", 1)
    rows = [(1, held), (None, held), (1, prose[3]), (None, prose[4]), (2, prose[2]), (3, near), (3, prose[5]), (None, prose[2]), (4, prose[6]), (4, prose[6]), (4, prose[7]), (5, prose[5]), (-7, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1, True) for i, t in rows], "doc_id long, text string, gone string, number int, known boolean").repartition(3)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in clean.collect()), key=str)
    assert kept == sorted(((i, t) for i, t in rows if t != held), key=str)
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = [(1, held), (1, prose[3]), (None, prose[4]), (2, prose[2]), (3, prose[5]), (4, prose[6]), (4, prose[7]), (-7, "")]
    assert kept == sorted(want, key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), str(tmp_path)).count() == 0

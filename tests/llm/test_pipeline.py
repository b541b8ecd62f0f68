"""The pipeline's stages take effect and keep clean documents."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_against_their_operators(spark):
    import corpus_pipeline as cp
    from strandweave.llm.common import stage
    from strandweave.llm.decontaminate import contaminated
    from strandweave.llm.minhash_dedup import near_duplicates
    from strandweave.llm.quality_fm import quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    good = stage(cp.quality_stage(spark, docs, SF), "t")
    assert good.columns == list(cp.COLUMNS)
    scored = quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(good) == ids(scored.where("predicted = 1"))
    one = stage(cp.near_dedup_stage(spark, good, SF), "t")
    assert ids(one) == ids(near_duplicates(good).where("kept"))
    clean = stage(cp.decontamination_stage(spark, one, SF), "t")
    held = ids(contaminated(one, spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert ids(clean) == ids(one) - held
    told = stage(cp.pii_stage(spark, clean, SF), "t")
    assert ids(told) == ids(clean) and told.columns == list(cp.COLUMNS)
    assert not any("@mail" in r["text"] for r in told.collect())
    out = cp.token_stage(spark, told, SF)
    assert out.where("not round_trip").count() == 0 and ids(out) == ids(clean)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_on_odd_rows(spark):
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, id int, decoded string"
    prose = "The house stands by the water, and the light of the morning falls on the old stones. " * 8
    mail = prose + "Write to ann@mail.org."
    rows = [(1, prose, "en", "a", len(prose)), (1, prose, "en", "a", len(prose)), (2, None, None, None, None), (None, mail, "en", "a", 9), (None, None, None, None, None), (3, "", "en", "a", 0), (4, mail, "en", "a", len(mail))]
    docs = spark.createDataFrame([(*r, "k", 7, "d") for r in rows], schema)
    for name, stage_of in cp.STAGES:
        out = stage_of(spark, docs, SF)
        found = sorted((str(r["doc_id"]) for r in out.select("doc_id").collect()))
        assert set(found) <= {"1", "2", "3", "4", "None"} and found.count("1") in (0, 2), name
        if name != "sentencepiece":
            assert out.columns == list(cp.COLUMNS)
        if name in ("decontamination", "pii", "sentencepiece"):
            assert found == ["1", "1", "2", "3", "4", "None", "None"]
        if name == "near dedup":
            assert {"1", "2", "3"} <= set(found) and found.count("None") == 2
        assert stage_of(spark, docs.where("false"), SF).count() == 0, name
    told = {r["doc_id"]: r for r in cp.pii_stage(spark, docs.where("doc_id = 4"), SF).collect()}
    assert "ann@mail" not in told[4]["text"] and told[4]["n_chars"] == len(told[4]["text"])

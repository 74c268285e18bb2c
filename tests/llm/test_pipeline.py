"""The pipeline's stages on the smallest tables: each keeps the columns of documents, and their decisions take effect."""

import os

import corpus_pipeline
from annalist.llm.common import read, written

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "test")
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    name, stage = corpus_pipeline.STAGES[-1]
    packed = stage(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == n


def test_repeats_of_over_50_words(spark):
    """51 repeated words are cut though they are far below 400 bytes, whatever blanks are between; 50 are not; 400 bytes of fewer words are."""
    own = lambda k, n=40: " ".join(f"w{i}own{k}" for i in range(n))
    p51, p50, long = [f"a{i}" for i in range(51)], [f"b{i}" for i in range(50)], " ".join(f"{i:040d}" for i in range(12))
    texts = [f"{own(1)} é {' '.join(p51)} {own(2)}", f"{own(3)} {'\n'.join(p51)}", f"{own(4)} {' '.join(p50)} {own(5)}", f"{' '.join(p50)} {own(6)}", f"{own(7)} {long} {own(8)}", f"{own(9)} {long}", "short", None, " ".join(p51), " ".join(p51)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint").repartition(3)
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    words = {i: (r.text or "").split() for i, r in got.items()}
    want = [[*own(1).split(), "é", *own(2).split()], own(3).split(), texts[2].split(), texts[3].split(), [*own(7).split(), *own(8).split()], own(9).split(), ["short"], [], [], []]
    assert words == dict(enumerate(want)) and all(r.n_chars == len(r.text) for r in got.values() if r.text is not None)


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, cuts string, k1 bigint, row string"


def odd_rows():
    words = lambda k, n: " ".join(f"{k}w{i}" for i in range(n))
    texts = [(1, words("a", 80)), (1, words("a", 80)), (2, words("a", 80)), (3, None), (4, ""), (5, words("b", 50_000)), (6, words("c", 30)), (6, words("d", 30)), (None, words("e", 60)), (None, words("e", 60)), (None, words("a", 80)), (None, None), (None, ""), (None, ""), (7, words("f", 90).replace("fw40 ", "x "))]
    return [(i, t, "en", "s", len(t or ""), 0.5, "c", 7, "r") for i, t in texts]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns: nothing that is no copy is lost, columns stay."""
    spark.createDataFrame([(1, "some item of no text here at all or anywhere else")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(99, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(odd_rows(), ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), "odd")
        assert docs.columns == [f.split()[0] for f in ODD.split(", ")], name
    got = sorted((r.doc_id or -1, (r.text or "")[:2], len((r.text or "").split())) for r in docs.collect())
    assert got == sorted([(1, "aw", 80), (3, "", 0), (4, "", 0), (5, "bw", 50_000), (6, "cw", 30), (6, "dw", 30), (-1, "ew", 60), (-1, "", 0), (-1, "", 0), (-1, "", 0), (7, "fw", 90)])
    assert {r.doc_id for r in corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()} == {1, 3, 4, 5, 6, 7, None}


def test_stages_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", ODD), ("benchmark", "item_id bigint, text string"), ("labels", "doc_id bigint, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_decisions_of_each_stage(spark, tmp_path):
    """Planted cases, each against a plain version of its stage's rule: toxic rows go, of near copies the first stays, repeated passages and leaks go."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8)))
    plain = [" ".join(word() for _ in range(70)) for _ in range(120)]
    passage, item = " ".join(word() for _ in range(55)), " ".join(word() for _ in range(14))
    near = plain[0].split()
    near[69] = "changed"
    rows = list(enumerate(plain)) + [(200, " ".join(near)), (201, plain[1]), (202, f"{plain[2][:100]} {passage} {word()}"), (203, f"{word()} {passage} {plain[3][:90]}"), (204, f"{' '.join(word() for _ in range(30))} {item.upper()} {word()}")]
    rows += [(300 + i, f"{' '.join(word() for _ in range(40))} scumbag{'s' * (i % 2)} {word()}") for i in range(60)]
    spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id bigint, text string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i >= 300)) for i, _ in rows if i % 3], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, left = read(spark, str(tmp_path), "documents"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), "planted")
        left.append({r.doc_id: r.text for r in docs.collect()})
    own = {i for i, _ in rows}
    assert set(left[0]) == own - set(range(300, 360))
    assert set(left[1]) == set(left[0]) - {200, 201}
    assert {i for i in left[1] if left[2][i] != left[1][i]} == {202, 203} and passage not in left[2][202] + left[2][203]
    assert set(left[3]) == set(left[2]) - {204}


def test_planted_passages_of_51_to_60_words(spark, tmp_path):
    """Short and long words, as they are and with other blanks between: op8 reports each passage, the stage cuts it, and clean texts stay."""
    import random

    from annalist.llm import suffixes

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    own = lambda: " ".join(word(rng.randint(2, 9)) + "1" for _ in range(rng.randint(20, 60)))
    rows, planted = [], {}
    for n in range(51, 61):
        for size in (2, 5, 12):
            passage = [word(size) for _ in range(n)]
            for blank in (" ", "\n", "  "):
                planted[len(rows)] = passage
                rows.append(f"{own()} {blank.join(passage)} {own()}")
    rows += [own() for _ in range(40)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(rows)], "doc_id bigint, text string, n_chars bigint").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    told = {r.doc_id: (r.n_passages, r.n_passage_words) for r in suffixes.op8_suffixes(spark, str(tmp_path)).collect()}
    assert told == {i: (1, len(planted[i])) if i in planted else (0, 0) for i in range(len(rows))}
    left = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, str(tmp_path)).collect()}
    assert all(left[i] == rows[i] for i in range(len(rows)) if i not in planted)
    assert all(left[i].split() == [w for w in rows[i].split() if w not in set(passage)] for i, passage in planted.items())

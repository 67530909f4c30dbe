"""Sparse features, SGML records across splits, newswire collections."""

import numpy as np
import pytest

from quillon.operators.sparse import dense, select_features
from quillon.sources.newswire import load_rcv1, load_reuters, one_class, read_sgml, read_vectors


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (30, 12)) * (rng.random((30, 12)) < 0.4)
    x[:, 3] = 2  # no variance
    x[7] = 0
    rows = [(i, f"f{j:02d}", float(x[i, j])) for i in range(30) for j in range(12) if x[i, j]]
    return x, spark.createDataFrame([*rows, (3, None, 9.0), (3, "f01", None)], "id long, feature string, value double")


@pytest.mark.parametrize("by", ["total", "variance"])
def test_selection_equals_the_dense_one(spark, cells, by):
    x, rows = cells
    score = x.sum(0) if by == "total" else x.var(0)
    order = sorted(range(12), key=lambda j: (-round(score[j], 9), j))[:5]
    found = select_features(rows, 5, 30, by)
    got = found.orderBy("at").collect()
    assert [r["feature"] for r in got] == [f"f{j:02d}" for j in sorted(order)] and [r["at"] for r in got] == list(range(5))
    assert np.allclose([r["variance"] for r in got], x.var(0)[sorted(order)])
    ids = spark.range(31)
    table = {r["id"]: r["features"] for r in dense(ids, rows, found, 5).collect()}
    assert all(table[i] == x[i, sorted(order)].tolist() for i in range(30)) and table[30] == [0.0] * 5


def test_least_variance_and_edges(spark, cells):
    x, rows = cells
    kept = {r["feature"] for r in select_features(rows, 100, 30, least=0.0).collect()}
    assert kept == {f"f{j:02d}" for j in range(12) if x[:, j].var() > 1e-12}
    none = select_features(rows.limit(0), 5, 30)
    assert none.count() == 0
    assert [r["features"] for r in dense(spark.range(1), rows, none, 0).collect()] == [[]]
    twice = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "id long, feature string, value double")
    found = select_features(twice, 1, 1)
    assert [r["features"] for r in dense(spark.createDataFrame([(1, "x"), (1, "y")], "id long, note string"), twice, found, 1).collect()] == [[3.0]] * 2
    with pytest.raises(ValueError):
        select_features(rows, 1, 1, "mean")


def record(n, topics, title, body, split="TRAIN", cgi="TRAINING-SET", unproc=False):
    text = f"<TEXT TYPE=\"UNPROC\">&#2;\n{body}\n</TEXT>" if unproc else f"<TEXT>&#2;\n<TITLE>{title}</TITLE>\n<DATELINE>    LONDON, March 3 - </DATELINE><BODY>{body}\n Reuter\n&#3;</BODY></TEXT>"
    return f'<REUTERS TOPICS="YES" LEWISSPLIT="{split}" CGISPLIT="{cgi}" OLDID="{n + 5000}" NEWID="{n}">\n<DATE>x</DATE>\n<TOPICS>{"".join(f"<D>{t}</D>" for t in topics)}</TOPICS>\n<PLACES><D>uk</D></PLACES>\n{text}\n</REUTERS>\n'


@pytest.fixture(scope="module")
def wire(tmp_path_factory):
    folder = tmp_path_factory.mktemp("wire")
    (folder / "Reuters21578").mkdir()
    rows = [record(k, ["earn"] if k % 2 else ["grain", "uk-trade"], f"Title {k}", "profit rose\nnet profit" if k % 2 else "wheat harvest\nof corn", "TEST" if k % 5 == 0 else "TRAIN") for k in range(1, 41)]
    rows += [record(41, ["earn", "grain"], "Both", "x"), record(42, [], "None", "x"), record(43, ["crude"], "", "oil wells", cgi="PUBLISHED-TESTSET", unproc=True)]
    for part in range(2):
        (folder / "Reuters21578" / f"reut2-00{part}.sgm").write_bytes(b'<!DOCTYPE lewis SYSTEM "lewis.dtd">\n' + "".join(rows[part::2]).encode() + b"\xff")
    return folder


def test_records_are_whole_wherever_files_are_split(spark, wire):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = read_sgml(spark, f"{wire}/Reuters21578/*.sgm")
        assert rows.rdd.getNumPartitions() > 8
        got = {r["id"]: r for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == list(range(1, 44))
    assert got[3]["text"] == "Title 3. profit rose net profit" and got[3]["topics"] == ["earn"] and got[3]["lewis_split"] == "TRAIN"
    assert got[2]["topics"] == ["grain", "uk-trade"] and got[42]["topics"] == [] and got[5]["lewis_split"] == "TEST"
    assert "oil wells" in got[43]["text"] and got[43]["cgi_split"] == "PUBLISHED-TESTSET"


def test_reuters(spark, wire):
    rows, matrix = load_reuters(spark, str(wire))
    got = {r["id"]: r for r in rows.collect()}
    assert sorted(got) == [*range(1, 41), 43]  # neither both topics nor none
    assert {got[1]["label"], got[2]["label"], got[43]["label"]} == {2, 3, 1}  # acq crude earn grain money-fx
    assert "profit" in matrix.terms and np.linalg.norm(got[1]["features"]) == pytest.approx(1)
    test, _ = load_reuters(spark, str(wire), "test", tfidf=False)
    assert sorted(r["id"] for r in test.collect()) == list(range(5, 41, 5))
    assert [r["id"] for r in load_reuters(spark, str(wire), "test-cgi", min_variance=-1.0)[0].collect()] == [43]
    with pytest.raises(ValueError):
        load_reuters(spark, str(wire), "val")
    every = one_class(read_sgml(spark, f"{wire}/Reuters21578/*.sgm"), None)
    assert {r["class"] for r in every.collect()} == {"earn", "crude"}


def test_rcv1(spark, tmp_path):
    (tmp_path / "lyrl2004_vectors_train.dat").write_text("1 5:0.5 7:0.25\n2 5:0.5 9:1.5\n3  7:1.0\n")
    (tmp_path / "lyrl2004_vectors_test_pt0.dat").write_text("4 9:2.0 11:0.125\n5 11:9.0\n\n6\n")
    (tmp_path / "rcv1-v2.topics.qrels").write_text("CCAT 1 1\nC11 1 1\nMCAT 2 1\nCCAT 3 1\nMCAT 3 1\nGCAT 4 1\nC11 5 1\nECAT 6 1\n")
    got = {r["id"]: r for r in load_rcv1(spark, str(tmp_path), n_features=2).collect()}
    # 3 has two classes and 5 none of them; sums of the rest: 9 3.5, 5 1.0, 7 0.25, 11 0.125
    assert {k: (r["split"], r["label"], r["features"]) for k, r in got.items()} == {1: ("train", 0, [0.5, 0.0]), 2: ("train", 3, [0.5, 1.5]), 4: ("test", 2, [0.0, 2.0]), 6: ("test", 1, [0.0, 0.0])}
    test = load_rcv1(spark, str(tmp_path), "test", n_features=2).collect()
    assert {r["id"]: r["features"] for r in test} == {4: [0.0, 2.0], 6: [0.0, 0.0]}  # the same features
    assert read_vectors(spark, f"{tmp_path}/*.dat").count() == 9
    with pytest.raises(ValueError):
        load_rcv1(spark, str(tmp_path), "val")

import gzip
import io
import os
import zipfile

import numpy as np
import pytest

from quillon.sources import catalog


def test_tables_of_every_layout(spark, tmp_path):
    rng = np.random.default_rng(0)
    for name, entry in catalog.TABLES.items():
        if entry.kind != "table":
            continue
        folder = tmp_path / name
        folder.mkdir()
        blank = " " if entry.separator != "," else ","
        want = []
        for split, path in entry.files:
            lines = ["a,b,c"] if entry.header else []
            for k in range(12):
                x = np.round(rng.normal(size=3), 3).tolist()
                code = k % 3
                own = ["1" if j == code else "0" for j in range(10)] if entry.one_hot else [str(2 + 9 * code)] * entry.labels
                fields = [*own, *map(str, x)] if entry.at == "first" else [*map(str, x), *own]
                fields = ["id"] * len(entry.drop) + fields
                lines.append(blank.join(fields))
                want.append((split, x, [code] * (1 if entry.one_hot else entry.labels)))
            lines.insert(3, "")
            lines.append(blank.join(["id"] * len(entry.drop) + ["?"] * (3 + entry.labels)))
            (folder / path).write_text("\n".join(lines) + "\n")
        got = catalog.load(spark, name, str(folder)).orderBy("split", "id").collect()
        assert sorted((r["split"], r["features"], r["labels"]) for r in got) == sorted(map(tuple, want)), name
        if len(entry.files) > 1:
            assert catalog.load(spark, name, str(folder), "train").count() == 12
    with pytest.raises(ValueError):
        catalog.load(spark, "unknown")


def test_features_and_labels_in_files_of_their_own(spark, tmp_path):
    for split in ("train", "test"):
        os.makedirs(tmp_path / split)
        (tmp_path / f"{split}/X_{split}.txt").write_text("".join(f" {k}.5  {k * 2}\n" for k in range(5)))
        (tmp_path / f"{split}/y_{split}.txt").write_text("".join(f"{k % 2 + 1}\n" for k in range(5)))
    rows = catalog.load(spark, "har", str(tmp_path), "test").orderBy("id").collect()
    assert [(r["features"], r["labels"]) for r in rows] == [([k + 0.5, k * 2.0], [k % 2]) for k in range(5)]
    (tmp_path / "data.csv").write_text(",g1,g2\ns0,1,2\ns1,3,4\n")
    (tmp_path / "labels.csv").write_text(",Class\ns1,B\ns0,A\n")
    rows = catalog.load(spark, "gene_expression_cancer_rna_seq", str(tmp_path)).collect()
    assert sorted((r["features"], r["labels"]) for r in rows) == [([1, 2], [0]), ([3, 4], [1])]
    for x in ("fac", "fou", "kar", "mor", "pix", "zer"):
        (tmp_path / f"mfeat-{x}").write_text("".join(f"{k}\n" for k in range(400)))
    rows = catalog.load(spark, "multiple_features", str(tmp_path)).orderBy("id").collect()
    assert len(rows) == 400 and rows[250]["features"] == [250.0] * 6 and rows[250]["labels"] == [1]


def test_series_and_archives(spark, tmp_path):
    for name, stem in catalog.SERIES.items():
        for split in ("TRAIN", "TEST"):
            if stem == "LSST":
                (tmp_path / f"{stem}_{split}.ts").write_text("@data\n# c\n1,2:3,4:6\n5,6:7,8:92\n")
            else:
                (tmp_path / f"{stem}_{split}.txt").write_text("1 0.5 0.25\n-1 1 2\n")
        rows = catalog.load(spark, name, str(tmp_path)).collect()
        want = [([1, 2, 3, 4], [0]), ([5, 6, 7, 8], [1])] if stem == "LSST" else [([0.5, 0.25], [1]), ([1, 2], [0])]
        assert sorted((r["features"], r["labels"]) for r in rows) == sorted(want * 2)
    for name, file in catalog.ARCHIVES.items():
        np.savez(tmp_path / file, **{f"{s}_{w}": np.arange(4).reshape(2, 2) if w == "images" else np.array([[0], [1]]) for s in ("train", "val", "test") for w in ("images", "labels")})
    assert catalog.load(spark, "path_mnist", str(tmp_path)).count() == 6
    assert [r["features"] for r in catalog.load(spark, "organ_mnist_3d", str(tmp_path), "val").orderBy("id").collect()] == [[0, 1], [2, 3]]


def idx(a):
    return bytes([0, 0, 8, a.ndim]) + np.array(a.shape, ">i4").tobytes() + a.astype(np.uint8).tobytes()


def test_binary_images(spark, tmp_path):
    x, y = np.arange(2 * 9).reshape(2, 3, 3), np.array([3, 7])
    for stem in ("train", "t10k"):
        (tmp_path / f"{stem}-images-idx3-ubyte").write_bytes(idx(x))
        (tmp_path / f"{stem}-labels-idx1-ubyte").write_bytes(idx(y))
    for name in ("mnist", "kmnist", "fmnist"):
        rows = catalog.load(spark, name, str(tmp_path), "test").orderBy("id").collect()
        assert [r["labels"] for r in rows] == [[3], [7]] and rows[1]["features"] == list(range(9, 18))
    record = np.concatenate([[4], np.arange(3072) % 256]).astype(np.uint8)
    for _, path in catalog.IMAGES["cifar10"].files:
        (tmp_path / path).write_bytes(record.tobytes() * 2)
    assert catalog.load(spark, "cifar10", str(tmp_path)).where("labels[0] = 4 and features[5] = 5").count() == 12
    (tmp_path / "train.bin").write_bytes(np.concatenate([[1, 2], np.zeros(3072)]).astype(np.uint8).tobytes())
    (tmp_path / "test.bin").write_bytes(np.concatenate([[1, 2], np.zeros(3072)]).astype(np.uint8).tobytes())
    assert catalog.load(spark, "cifar100", str(tmp_path)).first()["labels"] == [1, 2]
    rows, labels = catalog.decode("raw", (np.arange(27648) % 251).astype(np.uint8).tobytes(), bytes([3]))
    assert labels.tolist() == [[2]] and rows[0, 1] == 96 % 251
    rows, labels = catalog.decode("sparse", b"5 1:0.5 3:-1\n10 2:2\n", None)
    assert rows.tolist() == [[0.5, 0, -1], [0, 2, 0]] and labels.tolist() == [[4], [9]]
    files = []
    for a in (np.arange(8).reshape(2, 2, 2), np.array([1, 0])):
        held = io.BytesIO()
        np.save(held, a)
        files.append(held.getvalue())
    assert catalog.decode("npy", *files)[0].tolist() == [[0, 1, 2, 3], [4, 5, 6, 7]]


def test_texts_archives_and_small_classes(spark, tmp_path):
    for c in ("sport", "tech"):
        os.makedirs(tmp_path / "bbc" / c)
        (tmp_path / "bbc" / c / "001.txt").write_text(f"about {c}\nmore")
    rows = catalog.load_texts(spark, "bbcnews", str(tmp_path)).orderBy("label").collect()
    assert [(r["text"], r["label"], r["code"]) for r in rows] == [("about sport\nmore", "sport", 0), ("about tech\nmore", "tech", 1)]
    os.makedirs(tmp_path / "webkb/course/cornell")
    (tmp_path / "webkb/course/cornell/a").write_text("Date: x\nServer: y\n\n<html><b>Hi</b> there</html>")
    row = catalog.load_texts(spark, "webkb", str(tmp_path)).first()
    assert row["label"] == "course" and row["text"].split() == ["Hi", "there"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("inner.txt", "1")
    catalog.unpack(str(tmp_path / "a.zip"), str(tmp_path))
    assert (tmp_path / "inner.txt").read_text() == "1"
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress(b"2"))
    assert open(catalog.unpack(str(tmp_path / "b.txt.gz"), str(tmp_path))).read() == "2"
    assert catalog.fetch((tmp_path / "inner.txt").as_uri(), str(tmp_path / "got/x")) == str(tmp_path / "got/x")
    assert len(catalog.names()) == len(set(catalog.names())) > 60 and catalog.default_folder("z") == "z"
    rows = spark.createDataFrame([([0],), ([1],), ([1],), ([4],), ([4],)], "labels array<int>")
    assert sorted(r["labels"][0] for r in catalog.ignore_small_classes(rows, 2).collect()) == [0, 0, 1, 1]

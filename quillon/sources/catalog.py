"""Named public data sets: where their files lie in a folder, and how they become (id, split, features, labels).

Nothing is downloaded here unless asked for (:func:`fetch`): ``load`` reads a
folder that Spark can reach.  Labels of one labeling are numbered from 0 in the
order of their numbers, or of their names.
"""

from __future__ import annotations

import gzip
import io
import os
import shutil
import urllib.request
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.sources.files import read_npz


@dataclass(frozen=True)
class Entry:
    """``files``: (split, path) pairs; ``labels``: how many, and at the first or last of a row's fields."""

    kind: str
    files: tuple[tuple[str, str], ...]
    separator: str = ","
    labels: int = 1
    at: str = "last"
    drop: tuple[int, ...] = ()
    header: bool = False
    one_hot: bool = False
    url: str = ""


def _one(path: str) -> tuple[tuple[str, str], ...]:
    return (("all", path),)


def _two(train: str, test: str) -> tuple[tuple[str, str], ...]:
    return (("train", train), ("test", test))


BLANKS = r"\s+"
_UCI = "https://archive.ics.uci.edu/ml/machine-learning-databases/"

#: File names and layouts of public tables.
TABLES = {
    "banknotes": Entry("table", _one("data_banknote_authentication.txt"), url=_UCI + "00267/"),
    "spambase": Entry("table", _one("spambase.data"), url=_UCI + "spambase/"),
    "seeds": Entry("table", _one("seeds_dataset.txt"), BLANKS, url=_UCI + "00236/"),
    "skin": Entry("table", _one("Skin_NonSkin.txt"), BLANKS, url=_UCI + "00229/"),
    "soybean_small": Entry("table", _one("soybean-small.data"), url=_UCI + "soybean/"),
    "soybean_large": Entry("table", _two("soybean-large.data", "soybean-large.test"), at="first", url=_UCI + "soybean/"),
    "pendigits": Entry("table", _two("pendigits.tra", "pendigits.tes"), url=_UCI + "pendigits/"),
    "ecoli": Entry("table", _one("ecoli.data"), BLANKS, drop=(0,), url=_UCI + "ecoli/"),
    "htru2": Entry("table", _one("HTRU_2.csv"), url=_UCI + "00372/"),
    "letterrecognition": Entry("table", _one("letter-recognition.data"), at="first", url=_UCI + "letter-recognition/"),
    "statlog_shuttle": Entry("table", _two("shuttle.trn", "shuttle.tst"), BLANKS, url=_UCI + "statlog/shuttle/"),
    "dermatology": Entry("table", _one("dermatology.data"), url=_UCI + "dermatology/"),
    "statlog_australian_credit_approval": Entry("table", _one("australian.dat"), BLANKS, url=_UCI + "statlog/australian/"),
    "breast_cancer_wisconsin_original": Entry("table", _one("breast-cancer-wisconsin.data"), drop=(0,), url=_UCI + "breast-cancer-wisconsin/"),
    "optdigits": Entry("table", _two("optdigits.tra", "optdigits.tes"), url=_UCI + "optdigits/"),
    "semeion": Entry("table", _one("semeion.data"), BLANKS, 10, one_hot=True, url=_UCI + "semeion/"),
    "wholesale_customers": Entry("table", _one("Wholesale customers data.csv"), labels=2, at="first", header=True, url=_UCI + "00292/"),
    "forest_types": Entry("table", _two("training.csv", "testing.csv"), at="first", header=True),
    "iris": Entry("table", _one("iris.data"), url=_UCI + "iris/"),
    "wine": Entry("table", _one("wine.data"), at="first", url=_UCI + "wine/"),
    "breast_cancer": Entry("table", _one("wdbc.data"), at="first", drop=(0,), url=_UCI + "breast-cancer-wisconsin/"),
    "har": Entry("pair", (("train", "train/X_train.txt"), ("train_labels", "train/y_train.txt"), ("test", "test/X_test.txt"), ("test_labels", "test/y_test.txt")), BLANKS),
    "gene_expression_cancer_rna_seq": Entry("keyed", (("all", "data.csv"), ("labels", "labels.csv"))),
    "multiple_features": Entry("beside", tuple(("all", f"mfeat-{x}") for x in ("fac", "fou", "kar", "mor", "pix", "zer")), BLANKS, url=_UCI + "mfeat/"),
    "aloi_small": Entry("table", _one("aloi_small.data"), labels=2, at="first"),
    "fruit": Entry("table", _one("fruit.data"), labels=2, at="first"),
    "nrletters": Entry("table", _one("nrLetters.data"), labels=3, at="first"),
    "stickfigures": Entry("table", _one("stickfigures.data"), labels=2, at="first"),
}
#: Names of public image archives with <split>_images and <split>_labels.
ARCHIVES = {f"{x}_mnist": f"{x}mnist.npz" for x in ("path", "chest", "derma", "oct", "pneumonia", "retina", "breast", "blood", "tissue")}
ARCHIVES |= {f"organ_{x}_mnist": f"organ{x}mnist.npz" for x in "acs"}
ARCHIVES |= {f"{x}_mnist_3d": f"{x}mnist3d.npz" for x in ("organ", "nodule", "adrenal", "fracture", "vessel", "synapse")}
#: Names of public time series, each with <name>_TRAIN and <name>_TEST.
SERIES = {
    "motestrain": "MoteStrain", "proximal_phalanx_outline": "DistalPhalanxOutlineCorrect", "diatom_size_reduction": "DiatomSizeReduction",
    "symbols": "Symbols", "olive_oil": "OliveOil", "plane": "Plane", "sony_aibo_robot_surface": "SonyAIBORobotSurface1",
    "two_patterns": "TwoPatterns", "lsst": "LSST",
}
#: Public image sets as binary files.
IMAGES = {name: Entry("idx", tuple((f"{s}{p}", f"{stem}-{what}") for s, stem in (("train", "train"), ("test", "t10k")) for p, what in (("", "images-idx3-ubyte"), ("_labels", "labels-idx1-ubyte")))) for name in ("mnist", "kmnist", "fmnist")}
IMAGES |= {
    "cifar10": Entry("records", (*((("train", f"data_batch_{k}.bin")) for k in range(1, 6)), ("test", "test_batch.bin")), labels=1),
    "cifar100": Entry("records", _two("train.bin", "test.bin"), labels=2),
    "stl10": Entry("raw", (("train", "train_X.bin"), ("train_labels", "train_y.bin"), ("test", "test_X.bin"), ("test_labels", "test_y.bin"))),
    "usps": Entry("sparse", _two("usps", "usps.t")),
    "imagenet10": Entry("npy", (("all", "X.npy"), ("labels", "y.npy"))),
}
#: Public text sets with a folder for each class.
TEXTS = {"bbcsport": "bbcsport/*/*.txt", "bbcnews": "bbc/*/*.txt", "webkb": "webkb/*/*/*", "newsgroups": "20_newsgroups/*/*"}


def names() -> list[str]:
    return sorted([*TABLES, *ARCHIVES, *SERIES, *IMAGES, *TEXTS])


def default_folder(folder: str | None = None) -> str:
    """The given folder, that of DATASETS_HOME, or ~/datasets."""
    return folder or os.environ.get("DATASETS_HOME") or os.path.join(os.path.expanduser("~"), "datasets")


def fetch(url: str, path: str) -> str:
    """Download a file unless it is there; written beside first, so that a broken download leaves nothing."""
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with urllib.request.urlopen(url) as source, open(path + ".part", "wb") as target:  # noqa: S310
            shutil.copyfileobj(source, target)
        os.replace(path + ".part", path)
    return path


def unpack(path: str, folder: str) -> str:
    """Extract a zip or tar archive, or a single gzip file, into a folder."""
    if path.endswith(".gz") and not path.endswith(".tar.gz"):
        target = os.path.join(folder, os.path.basename(path)[:-3])
        with gzip.open(path) as source, open(target, "wb") as out:
            shutil.copyfileobj(source, out)
        return target
    options = {} if path.endswith(".zip") else {"filter": "data"}
    shutil.unpack_archive(path, folder, **options)
    return folder


def numbered(rows: DataFrame, labels: int) -> DataFrame:
    """(…, labels) with each of a row's label strings as its rank among all of its labeling; only distinct values are sorted."""
    values = rows.select(F.posexplode("labels").alias("of", "value")).distinct()
    order = Window.partitionBy("of").orderBy(F.expr("try_cast(value as double)").asc_nulls_last(), "value")
    codes = values.withColumn("code", F.row_number().over(order) - 1)
    held = codes.groupBy("of").agg(F.map_from_entries(F.collect_list(F.struct("value", "code"))).alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("of", "m"))).alias("maps"))
    found = F.array(*[F.col("maps")[F.lit(k)][F.col("labels")[k]] for k in range(labels)])
    return rows.crossJoin(F.broadcast(held)).withColumn("labels", found).drop("maps")


def _lines(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(file order, value) of non-blank lines."""
    rows = spark.read.text(path, wholetext=False).select(F.monotonically_increasing_id().alias("id"), F.trim("value").alias("value")).where("value <> ''")
    if header:
        first = rows.agg(F.min_by("value", "id").alias("v")).first()["v"]
        rows = rows.where(F.col("value") != F.lit(first))
    return rows


def _fields(rows: DataFrame, separator: str) -> DataFrame:
    return rows.select("id", F.transform(F.split("value", separator), lambda x: F.trim(F.regexp_replace(x, '^"|"$', ""))).alias("f"))


def _complete(rows: DataFrame) -> DataFrame:
    return rows.where(~F.exists("features", lambda x: x.isNull() | F.isnan(x)))


def _numbers(column) -> object:
    return F.transform(column, lambda x: x.try_cast("double"))


def _table(spark: SparkSession, folder: str, entry: Entry) -> DataFrame:
    parts = []
    for split, path in entry.files:
        rows = _fields(_lines(spark, f"{folder}/{path}", entry.header), entry.separator)
        if entry.drop:
            rows = rows.withColumn("f", F.filter("f", lambda x, k: ~k.isin(*entry.drop)))
        n, m = F.size("f"), entry.labels
        more = F.greatest(n - m, F.lit(0))
        found = F.slice("f", 1, m) if entry.at == "first" else F.slice("f", more + 1, F.lit(m))
        rest = F.slice("f", F.lit(m + 1), more) if entry.at == "first" else F.slice("f", F.lit(1), more)
        if entry.one_hot:
            found = F.array((F.array_position(F.transform(found, lambda x: x.try_cast("double").cast("int")), 1) - 1).cast("string"))
        parts.append(rows.where(n > m).select(F.lit(split).alias("split"), "id", _numbers(rest).alias("features"), found.alias("labels")))
    rows = _complete(_union(parts))
    return numbered(rows, 1 if entry.one_hot else entry.labels)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with their number in the file, counted per partition of the reader and added up."""
    rows = rows.withColumn("part", F.shiftright("id", 33)).withColumn("at", F.col("id").bitwiseAND(F.lit((1 << 33) - 1)))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("row", F.col("at") + F.col("before")).drop("part", "at", "before")


def _pair(spark: SparkSession, folder: str, entry: Entry) -> DataFrame:
    files, parts = dict(entry.files), []
    for split in ("train", "test"):
        x = _ranked(_fields(_lines(spark, f"{folder}/{files[split]}"), entry.separator))
        y = _ranked(_lines(spark, f"{folder}/{files[split + '_labels']}")).select("row", F.array("value").alias("labels"))
        parts.append(x.join(y, "row").select(F.lit(split).alias("split"), F.col("row").alias("id"), _numbers("f").alias("features"), "labels"))
    return numbered(_complete(_union(parts)), 1)


def _keyed(spark: SparkSession, folder: str, entry: Entry) -> DataFrame:
    files = dict(entry.files)
    x = _fields(_lines(spark, f"{folder}/{files['all']}", True), ",").select("id", F.col("f")[0].alias("key"), _numbers(F.slice("f", F.lit(2), F.size("f") - 1)).alias("features"))
    y = _fields(_lines(spark, f"{folder}/{files['labels']}", True), ",").select(F.col("f")[0].alias("key"), F.array(F.col("f")[1]).alias("labels"))
    return numbered(_complete(x.join(y, "key").select(F.lit("all").alias("split"), "id", "features", "labels")), 1)


def _beside(spark: SparkSession, folder: str, entry: Entry, per_class: int = 200) -> DataFrame:
    out = None
    for k, (_, path) in enumerate(entry.files):
        own = _ranked(_fields(_lines(spark, f"{folder}/{path}"), entry.separator)).select("row", _numbers("f").alias(f"f{k}"))
        out = own if out is None else out.join(own, "row")
    features = F.concat(*[F.col(f"f{k}") for k in range(len(entry.files))])
    return out.select(F.lit("all").alias("split"), F.col("row").alias("id"), features.alias("features"), F.array(F.floor(F.col("row") / per_class).cast("int")).alias("labels"))


def _series(spark: SparkSession, folder: str, name: str) -> DataFrame:
    parts = []
    for split in ("train", "test"):
        stem = f"{folder}/{name}_{split.upper()}"
        dots = name == "LSST"
        lines = _lines(spark, stem + (".ts" if dots else ".txt")).where(~F.col("value").rlike("^[@#]"))
        values = _fields(lines, r"[,:\s]+")
        n = F.size("f")
        label = F.element_at("f", -1) if dots else F.col("f")[0]
        rest = F.slice("f", F.lit(1), F.greatest(n - 1, F.lit(0))) if dots else F.slice("f", F.lit(2), F.greatest(n - 1, F.lit(0)))
        label = F.coalesce(label.try_cast("double").cast("int").cast("string"), label)
        parts.append(values.select(F.lit(split).alias("split"), "id", _numbers(rest).alias("features"), F.array(label).alias("labels")))
    return numbered(_complete(_union(parts)), 1)


def _binary(spark: SparkSession, folder: str, entry: Entry) -> DataFrame:
    """Files opened in one task each; labels come with the records or from the file beside."""
    files = [(split, path) for split, path in entry.files if not split.endswith("labels")]
    beside = {split.removesuffix("_labels") if split != "labels" else "all": path for split, path in entry.files if split.endswith("labels")}
    parts = []
    for split, path in files:
        own = spark.read.format("binaryFile").load(f"{folder}/{path}").select(F.col("content").alias("x"))
        if split in beside:
            own = own.crossJoin(spark.read.format("binaryFile").load(f"{folder}/{beside[split]}").select(F.col("content").alias("y")))
        else:
            own = own.withColumn("y", F.lit(None).cast("binary"))
        parts.append(own.select(F.lit(split).alias("split"), F.lit(path).alias("file"), "x", "y"))

    def parse(frames):
        for frame in frames:
            for split, x, y in zip(frame["split"], frame["x"], frame["y"]):
                rows, labels = decode(entry.kind, bytes(x), None if y is None else bytes(y), entry.labels)
                for k in range(0, len(rows), 1024):
                    yield pd.DataFrame({"split": split, "id": np.arange(k, min(k + 1024, len(rows))), "features": list(rows[k : k + 1024].astype(float)), "labels": list(labels[k : k + 1024].astype("int32"))})

    return _union(parts).mapInPandas(parse, "split string, id long, features array<double>, labels array<int>")


def decode(kind: str, x: bytes, y: bytes | None, labels: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Rows and labels of a binary file: idx, records of label bytes and 3072 pixels, raw 27648 pixels, npy, or sparse text."""
    if kind == "idx":
        dims = x[3]
        shape = np.frombuffer(x, ">i4", dims, 4)
        rows = np.frombuffer(x, np.uint8, offset=4 + 4 * dims).reshape(shape[0], -1)
        return rows, np.frombuffer(y, np.uint8, offset=8).reshape(-1, 1)
    if kind == "records":
        rows = np.frombuffer(x, np.uint8).reshape(-1, labels + 3072)
        return rows[:, labels:], rows[:, :labels]
    if kind == "raw":  # pixels lie column by column
        rows = np.frombuffer(x, np.uint8).reshape(-1, 3, 96, 96).transpose(0, 1, 3, 2).reshape(-1, 27648)
        return rows, np.frombuffer(y, np.uint8).reshape(-1, 1) - 1
    if kind == "npy":
        rows, own = (np.load(io.BytesIO(v), allow_pickle=False) for v in (x, y))
        return rows.reshape(len(rows), -1), own.reshape(len(own), -1)
    lines = [line.split() for line in x.decode().splitlines() if line.strip()]
    size = max((int(cell.split(":")[0]) for line in lines for cell in line[1:]), default=0)
    rows = np.zeros((len(lines), size))
    for k, line in enumerate(lines):
        for cell in line[1:]:
            at, value = cell.split(":")
            rows[k, int(at) - 1] = float(value)
    return rows, np.array([[int(float(line[0])) - 1] for line in lines]).reshape(-1, 1)


def load(spark: SparkSession, name: str, folder: str | None = None, subset: str = "all") -> DataFrame:
    """(split, id, features, labels) of a named set; ``subset``: train, test, val or all."""
    folder = default_folder(folder)
    if name in TABLES:
        entry = TABLES[name]
        rows = {"table": _table, "pair": _pair, "keyed": _keyed, "beside": _beside}[entry.kind](spark, folder, entry)
    elif name in ARCHIVES:
        rows = read_npz(spark, f"{folder}/{ARCHIVES[name]}").select("split", F.col("row").alias("id"), "features", "labels")
    elif name in SERIES:
        rows = _series(spark, folder, SERIES[name])
    elif name in IMAGES:
        rows = _binary(spark, folder, IMAGES[name])
    else:
        raise ValueError(f"unknown data set {name}" if name not in TEXTS else f"{name} holds texts: use load_texts")
    known = {"train", "test", "val"} if name in ARCHIVES else {"train", "test"}
    if subset != "all" and subset not in known:
        raise ValueError(f"subset is all or one of {sorted(known)}")
    return rows if subset == "all" else rows.where(F.col("split") == subset)


def load_texts(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """(path, text, label, code): one row a file; the class is the name of its folder, tags and mail headers are taken out."""
    path = f"{default_folder(folder)}/{TEXTS[name]}"
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    parts = F.split("path", "/")
    label = F.element_at(parts, -3 if name == "webkb" else -2)
    text = F.col("text")
    if name in ("webkb", "newsgroups"):
        text = F.regexp_replace(text, r"(?s)\A(?:[A-Za-z-]+:[^\n]*\n)+\s*\n", "")
        text = F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", " "), r"(?m)^[>|].*$", "")
    rows = rows.select("path", text.alias("text"), F.url_decode(label).alias("label"))
    codes = rows.select("label").distinct().withColumn("code", F.row_number().over(Window.orderBy("label")) - 1)
    return rows.join(F.broadcast(codes), "label").select("path", "text", "label", "code")


def ignore_small_classes(rows: DataFrame, least: int) -> DataFrame:
    """Rows of classes with at least that many members, numbered anew."""
    counts = rows.groupBy(F.col("labels")[0].alias("code")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kept = counts.withColumn("new", F.row_number().over(Window.orderBy("code")).cast("int") - 1)
    return rows.join(F.broadcast(kept), F.col("labels")[0] == F.col("code")).withColumn("labels", F.array("new")).drop("code", "n", "new")

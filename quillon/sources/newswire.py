"""Newswire collections: SGML records in large files, and sparse vectors with labels beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.preprocessing import TextMatrix
from quillon.operators.sparse import dense, select_features
from quillon.sources.catalog import default_folder

#: The default classes of both collections.
REUTERS_TOPICS = ("grain", "money-fx", "earn", "acq", "crude")
RCV1_CLASSES = ("CCAT", "GCAT", "MCAT", "ECAT")
#: File names of the collections.
REUTERS_FILES = "Reuters21578/*.sgm"
RCV1_TRAIN, RCV1_TEST, RCV1_TOPICS = "lyrl2004_vectors_train.dat*", "lyrl2004_vectors_test_pt*.dat*", "rcv1-v2.topics.qrels*"


def _attribute(head: Column, name: str) -> Column:
    return F.regexp_extract(head, f'{name}="([^"]*)"', 1)


def read_sgml(spark: SparkSession, path: str) -> DataFrame:
    """(id, lewis_split, cgi_split, topics, text), one row a record.

    Records end at their closing tag and are read like lines, so a file is
    split among tasks wherever Spark splits it.  The text is the title, a full
    stop, and the body as one line without the agency's closing line; records
    without a body have what stands in their text element.  Bytes that are no
    UTF-8 are left out.  What stands outside records is no row.
    """
    rows = spark.read.text(path, lineSep="</REUTERS>").where(F.col("value").contains("<REUTERS"))
    raw = F.regexp_replace("value", "�", "")
    head = F.regexp_extract(raw, r"<REUTERS([^>]*)>", 1)
    topics = F.regexp_extract_all(F.regexp_extract(raw, r"(?s)<TOPICS>(.*?)</TOPICS>", 1), F.lit(r"<D>(.*?)</D>"), F.lit(1))
    title = F.regexp_extract(raw, r"(?s)<TITLE>(.*?)</TITLE>", 1)
    body = F.regexp_extract(raw, r"(?s)<BODY>(.*?)</BODY>", 1)
    plain = F.regexp_extract(raw, r'(?s)<TEXT TYPE="UNPROC">(.*?)</TEXT>', 1)
    text = F.when(raw.contains("<BODY>"), body).otherwise(plain)
    # the closing line and the end-of-text mark
    text = F.regexp_replace(text, r"(?m)^ Reuter\s*$|&#3;", "")
    text = F.trim(F.regexp_replace(text, r"\r?\n", " "))
    text = F.concat(F.when(title != "", F.concat(title, F.lit(". "))).otherwise(""), text)
    return rows.select(_attribute(head, "NEWID").cast("long").alias("id"), _attribute(head, "LEWISSPLIT").alias("lewis_split"), _attribute(head, "CGISPLIT").alias("cgi_split"), topics.alias("topics"), text.alias("text"))


def one_class(rows: DataFrame, classes: tuple[str, ...] | None, names: str = "topics") -> DataFrame:
    """Rows with exactly one of the classes (of all if None) in the array ``names``, and its number in alphabetical order as ``label``."""
    own = F.col(names) if classes is None else F.filter(names, lambda t: t.isin(*classes))
    kept = rows.withColumn("class", own[0]).where(F.size(own) == 1)
    if classes is None:
        found = [r["class"] for r in kept.select("class").distinct().collect()]  # classes
        classes = tuple(found)
    order = sorted(classes)
    if not order:
        return kept.withColumn("label", F.lit(None).cast("int"))
    return kept.withColumn("label", (F.array_position(F.array(*[F.lit(c) for c in order]), F.col("class")) - 1).cast("int"))


def load_reuters(spark: SparkSession, folder: str | None = None, subset: str = "all", topics: tuple[str, ...] | None = REUTERS_TOPICS, **options) -> tuple[DataFrame, TextMatrix]:
    """(id, class, label, features) of articles with one of the topics, and the matrix that made them.

    ``subset``: all, train, test (by the first published split), train-cgi or
    test-cgi.  ``options``: of :meth:`TextMatrix.fit`, which sees the subset.
    """
    if subset not in ("all", "train", "test", "train-cgi", "test-cgi"):
        raise ValueError("subset is all, train, test, train-cgi or test-cgi")
    rows = one_class(read_sgml(spark, f"{default_folder(folder)}/{REUTERS_FILES}"), topics)
    if subset in ("train", "test"):
        rows = rows.where(F.col("lewis_split") == subset.upper())
    elif subset != "all":
        rows = rows.where(F.col("cgi_split") == ("TRAINING-SET" if subset == "train-cgi" else "PUBLISHED-TESTSET"))
    docs = rows.select("id", "class", "label", "text")
    matrix = TextMatrix.fit(docs, **options)
    return docs.select("id", "class", "label").join(matrix.transform(docs.select("id", "text")), "id"), matrix


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, feature, value) of lines ``id feature:value feature:value``; a line without features gives one row of nulls."""
    fields = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(fields[0].cast("long").alias("id"), F.filter(fields, lambda f: f.contains(":")).alias("f"))
    cell = F.split("f", ":")
    return rows.select("id", F.explode_outer("f").alias("f")).select("id", cell[0].cast("int").alias("feature"), cell[1].cast("double").alias("value"))


def load_rcv1(spark: SparkSession, folder: str | None = None, subset: str = "all", classes: tuple[str, ...] = RCV1_CLASSES, n_features: int = 2000) -> DataFrame:
    """(split, id, class, label, features) of stories of exactly one of the classes.

    Features are those of the largest sum over such stories of both splits,
    whatever the subset, in the order of their numbers; they stay sparse until
    they are chosen.
    """
    if subset not in ("all", "train", "test"):
        raise ValueError("subset is all, train or test")
    folder = default_folder(folder)
    cells = None
    for split, path in (("train", RCV1_TRAIN), ("test", RCV1_TEST)):
        own = read_vectors(spark, f"{folder}/{path}").withColumn("split", F.lit(split))
        cells = own if cells is None else cells.unionByName(own)
    words = F.split(F.trim("value"), r"\s+")
    topics = spark.read.text(f"{folder}/{RCV1_TOPICS}").select(words[0].alias("topic"), words[1].cast("long").alias("id")).where(F.col("topic").isin(*classes))
    single = one_class(topics.groupBy("id").agg(F.collect_set("topic").alias("topics")), classes)  # as many names as classes
    kept = cells.join(single.select("id", "class", "label"), "id")
    selected = select_features(kept, n_features, 1)
    size = selected.count()
    if subset != "all":
        kept = kept.where(F.col("split") == subset)
    return dense(kept.select("split", "id", "class", "label").distinct(), kept, selected, size).select("split", "id", "class", "label", "features")

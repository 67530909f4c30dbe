"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Base identifiers (email, ip, card, phone) are found by patterns.  They are seeds,
and so are long hexadecimal strings for the kind ``secret``.  The words around an
occurrence form its lexical patterns: the two words before it, the one before,
the one after, and the one before with the one after.  Every other token that
has an at sign or at least four digits, and every group of adjoining number
tokens, is a candidate with lexical patterns of its own.  The graph of patterns
and instances, one row for each pair with its count, is scored in rounds: a
pattern's confidence for a kind is the share of its occurrences whose instance
is accepted for the kind, and an instance is accepted if it is a seed or stands
in patterns of high confidence and enough distinct support for half of its
occurrences or more.  Both sets only grow, and rounds end when no pair of
instance and kind is new.  Occurrences that stand in a pattern of high
confidence are then reported beside the base spans.  A seed of the kind secret
is no base span; it is reported where its context is confirmed, so that a bare
digest in running text is left alone.

The regular expressions match what the plain ones in the comments match, in
linear time: possessive loops, and starts only where a run begins (or where the
last match ended).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import reliable, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans, in the order of the result.
ADDED = (*KINDS, "secret")
#: The base patterns in the order of KINDS.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Adjoining number tokens, and any other token with a digit or an at sign.
TOKEN = r"(?<!\S)\(?+[0-9](?:[()./-]*+\x20?+\(?+[0-9])*+(?![\p{L}\p{N}@_])|(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Fixed value: seeds of the kind secret, hexadecimal strings with digits and letters.
SECRET = "^(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}$"
#: What a pattern needs: confidence and distinct instances of its kind; and the share of an instance's occurrences that must stand in such patterns.
CONFIDENCE, SUPPORT, SHARE = 0.8, 5, 0.5


#: Matches that are placed together; keeps the placing of n matches at n * RUN + (n / RUN)^2 steps.
RUN = 64
_SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"


def _plain(text: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(text, r"\s+", " ")


def _located(text: Column, pattern: str, hint: Column, words: bool = False) -> Column:
    """array<struct<start,end,value,before,after>> of the matches, in code points, end exclusive.

    ``before`` and ``after``: the last two words and the first word of the text
    between the match and its neighbours.
    ``hint``: a cheap test that every text with a match passes.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def append(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["gap"])
        end = start + F.length(m["value"])
        span = F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after"))
        return F.when(m["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    def run(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("out")), append)

    def join(acc: Column, part: Column) -> Column:
        def move(m: Column) -> Column:
            return F.struct((acc["at"] + m["start"]).alias("start"), (acc["at"] + m["end"]).alias("end"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after"))

        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(part["out"], move))).alias("out"))

    # one gap more than values; its value is null
    if words:
        first = lambda gap: F.substring_index(F.ltrim(_plain(gap)), " ", 1)
        last = lambda gap: F.substring_index(F.rtrim(_plain(gap)), " ", -2)
        after = F.transform(F.slice(between, F.lit(2), F.size(between)), first)
        pairs = F.arrays_zip(found.alias("value"), between.alias("gap"), F.transform(between, last).alias("before"), after.alias("after"))
    else:
        pairs = F.transform(F.arrays_zip(found.alias("value"), between.alias("gap")), lambda m: F.struct(m["value"].alias("value"), m["gap"].alias("gap"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")))
    runs = F.transform(F.array(pairs), lambda p: F.transform(F.sequence(F.lit(1), F.size(p), F.lit(RUN)), lambda k: run(F.slice(p, k, RUN))))[0]
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{_SPAN}>>)").alias("out"))
    placed = F.aggregate(runs, start, join, lambda acc: F.flatten(acc["out"]))
    return F.when(hint, placed).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def _hint(text: Column, kind: str) -> Column:
    if kind in ("email", "phone"):
        return text.contains("@" if kind == "email" else "+")
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][\x20-]?[0-9][\x20-]?[0-9]")


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return (F.length(digits) >= 16) & (F.length(digits) <= 19) & F.when(F.length(digits) <= 19, F.call_function("luhn_check", digits)).otherwise(False)
    return (F.length(digits) >= 8) & (F.length(digits) <= 15)


def _contexts(before: Column, after: Column) -> Column:
    """The lexical patterns of an occurrence: lower-cased words without punctuation but = : _ -, digits as 0, each with a letter."""
    clean = lambda words: F.regexp_replace(F.regexp_replace(F.lower(words), r"[^\p{L}\p{N}=:_ -]", ""), r"\p{N}", "0")
    two, one, next_one = clean(before), clean(F.substring_index(before, " ", -1)), clean(after)
    named = lambda mark, words: F.when(words.rlike(r"\p{L}"), F.concat(F.lit(mark), words))
    found = F.array(
        named("2 ", F.when(two.rlike(r"\S \S"), two)),
        named("1 ", one),
        named("+ ", next_one),
        named("& ", F.when((one != "") & (next_one != ""), F.concat(one, F.lit(" _ "), next_one))),
    )
    return F.filter(found, lambda c: c.isNotNull())


def base_spans(text: Column) -> Column:
    """array<struct<kind,start,end>> of the base identifiers, by kind as in KINDS, then by start."""

    def of(kind: str) -> Column:
        kept = F.filter(_located(text, PATTERNS[kind], _hint(text, kind)), lambda m: _valid(kind, m["value"]))
        return F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    return F.concat(*map(of, KINDS))


def occurrences(text: Column) -> Column:
    """array<struct<start,end,value,contexts,kind>> of identifiers and candidates that have a context.

    ``kind`` is that of a seed, null for other candidates.  Candidates are
    trimmed of punctuation; they have an at sign or at least four digits.
    """
    any_of = "|".join([PATTERNS["phone"], PATTERNS["ip"], PATTERNS["card"], PATTERNS["email"].replace("|\\G", ""), TOKEN])
    whole = {kind: f"^(?:{PATTERNS[kind].replace('|\\G', '')})$" for kind in KINDS}

    def kind_of(value: Column) -> Column:
        out = F.when(value.rlike(SECRET), F.lit("secret"))
        for kind in ("card", "ip", "email", "phone"):
            out = F.when(value.rlike(whole[kind]) & _valid(kind, value), F.lit(kind)).otherwise(out)
        return out

    def trimmed(m: Column) -> Column:
        rest = F.regexp_replace(m["value"], r"^[^\p{L}\p{N}(+]+", "")
        value = F.regexp_replace(rest, r"[^\p{L}\p{N})]++$", "")
        start = m["start"] + F.length(m["value"]) - F.length(rest)
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), m["before"].alias("before"), m["after"].alias("after"))

    marked = F.transform(
        F.transform(_located(text, any_of, text.rlike("[0-9@]"), words=True), trimmed),
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lower(m["value"]).alias("value"), _contexts(m["before"], m["after"]).alias("contexts"), kind_of(m["value"]).alias("kind")),
    )
    return F.filter(
        marked,
        lambda m: (F.size(m["contexts"]) > 0) & (m["kind"].isNotNull() | m["value"].contains("@") | (F.length(F.regexp_replace(m["value"], "[^0-9]", "")) >= 4)),
    )


def learn(seen: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """(context, kind) of the patterns of high confidence.

    ``seen``: rows (contexts, value, kind) of occurrences, kind null if
    unknown.  A value that is a seed of several kinds counts for each.
    """
    rows = reliable(seen.groupBy("contexts", "value").agg(F.count("*").alias("n"), F.collect_set("kind").alias("kinds")))
    edges = rows.select(F.explode("contexts").alias("context"), "value", "n").groupBy("context", "value").agg(F.sum("n").alias("n"))
    totals = edges.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("instances")).where(F.col("instances") >= support)
    # a pattern with fewer instances can never have the support
    edges = reliable(edges.join(totals.drop("instances"), "context"))
    amounts = rows.groupBy("value").agg(F.sum("n").alias("amount"))
    known = reliable(rows.select("value", F.explode("kinds").alias("kind")).distinct())
    while True:
        hits = edges.join(known, "value").groupBy("context", "kind").agg(F.sum("n").alias("hit"), F.count("*").alias("distinct"), F.first("total").alias("total"))
        good = reliable(hits.where((F.col("distinct") >= support) & (F.col("hit") >= confidence * F.col("total"))).select("context", "kind"))
        # an occurrence counts once, however many of its patterns are good
        apart = rows.withColumn("row", F.struct("contexts", "value")).select("row", "value", "n", F.explode("contexts").alias("context"))
        standing = apart.join(good, "context").select("row", "value", "n", "kind").distinct().groupBy("value", "kind").agg(F.sum("n").alias("hit"))
        accepted = standing.join(amounts, "value").where(F.col("hit") >= share * F.col("amount")).select("value", "kind")
        new = reliable(accepted.join(known, ["value", "kind"], "left_anti"))
        if not new.limit(1).count():
            return good
        known = reliable(known.unionAll(new))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, base, added, discovered) of every row: arrays of struct<kind,start,end>, and a number.

    ``hash`` is that of the text; null texts count as empty.  Added spans are
    never part of a base span.  ``discovered`` counts those of them that no seed
    pattern matches: what only their context gives away.  Repeated rows give equal rows; null ids are kept; a
    table without seeds learns nothing and adds nothing; other columns are not
    read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = reliable(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), base_spans(text).alias("base"), occurrences(text).alias("seen")))
    rows = own.select("id", "hash", "base", F.explode("seen").alias("m")).select("id", "hash", "base", "m.*")
    good = learn(rows.select("contexts", "value", "kind"))
    new = (
        rows.where("kind is null or kind = 'secret'")
        .where(~F.exists("base", lambda b: (b["start"] <= F.col("start")) & (b["end"] >= F.col("end"))))
        .select("id", "hash", "start", "end", F.col("kind").isNull().alias("unseen"), F.explode("contexts").alias("context"))
        .join(good, "context")
        .groupBy("id", "hash")
        .agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added"), F.size(F.collect_set(F.when(F.col("unseen"), F.struct("kind", "start", "end")))).alias("discovered"))
        .withColumnsRenamed({"id": "of_id", "hash": "of_hash"})
    )
    joined = own.join(new, (own["hash"] == new["of_hash"]) & own["id"].eqNullSafe(new["of_id"]), "left")
    return joined.select("id", "hash", "base", F.coalesce("added", F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")).alias("added"), F.coalesce("discovered", F.lit(0)).alias("discovered"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with each span in the text replaced by its kind in brackets.

    Null texts and null ids stay null, repeated rows stay, an empty table stays
    empty; other columns may have any name.
    """
    found = find(docs, id_col, text_col).where((F.size("base") > 0) | (F.size("added") > 0))
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    found = found.select("id", "hash", spans.alias("spans")).distinct()
    # the caller's columns stay in one struct, so that no name can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row")[text_col]
    joined = rows.join(found, (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("hash")) & F.col("row")[id_col].eqNullSafe(F.col("id")), "left")
    clean = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct((-s["back"]).alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    text = F.when(F.col("spans").isNull(), text).otherwise(clean)
    return joined.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def op1_pii(spark, sf_dir) -> DataFrame:
    """Base spans as counts and digest, and all spans; ``n_added`` counts the spans that the method adds, ``n_discovered`` those that match no seed pattern."""
    found = find(table(spark, sf_dir, "documents"))
    of = lambda spans, kind: F.filter(spans, lambda s: s["kind"] == kind)
    every = F.concat(*[F.array_sort(F.concat(of("base", k), of("added", k))) for k in ADDED])
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(of("base", k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.col("discovered").cast("long").alias("n_discovered"),
    )

"""Canonical exact digests: normalised, folded texts in wide hash buckets with byte comparison.

A text's canonical form is its compatibility composition (NFKC), case-folded and
composed again, with each run of white space as one space and none at the ends.
The fingerprint is a 128-bit xxHash of that form. Documents with one hash are
compared byte by byte: the distinct canonical forms in a bucket are numbered, and
a form with a number over 0 (two forms with one hash) has it in its fingerprint.

All of it is DataFrame expressions; normalisation and folding call the Unicode
library that Spark brings along, inside the JVM.

Defined results: null counts as empty, and all texts that are empty after folding
have one fingerprint; repeated rows are rows of one group; ids may be of any type that
has an order; rows with one id are ordered by a hash of id and text (key), equal
ones by their place; a row without id comes after all others; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, staged, tuned

#: Classes and methods of ICU4J.
NORMALIZER, CHARACTER = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"
SPACES = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
#: Hashes of several rows that are sent to every task instead of shuffling the texts (some 64 bytes each); more of them are joined by a shuffle.
BROADCAST_HASHES = 300_000
#: What tells documents apart: two hashes of id and text.
KEY = ("a", "b")


def canonical(text: Column) -> Column:
    """The canonical form; text must not be null."""
    composed = F.reflect(F.lit(NORMALIZER), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit(CHARACTER), F.lit("foldCase"), composed, F.lit(True))
    again = F.reflect(F.lit(NORMALIZER), F.lit("compose"), folded, F.lit(True))
    return F.btrim(F.regexp_replace(again, SPACES, " "))


def wide_hash(form: Column) -> Column:
    """32 hex digits; the two halves come from different seeds."""
    half = lambda salt: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(salt), form))), 16, "0")
    return F.concat(half(1), half(2))


def number_in_bucket(forms: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """(hash, form, number) of the forms that are not the first of their bucket: canonical forms that differ and have one hash.

    Only hashes of several rows (hashes: those of all rows, if at hand) are looked
    at. Equal forms are pre-aggregated, so that a group of copies, however large,
    is one row a task.
    """
    every = forms.select("hash") if hashes is None else hashes
    several = staged(every.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "digest-hashes")
    distinct = forms.join(_few(several), "hash").groupBy("hash", "form").agg(F.count("*").alias("n"))
    clash = distinct.groupBy("hash").agg(F.count("*").alias("forms")).filter("forms > 1").select("hash")
    order = Window.partitionBy("hash").orderBy("form")
    return distinct.join(clash, "hash").select("hash", "form", (F.row_number().over(order) - 1).alias("number")).filter("number > 0")


def fingerprint(hash_: Column, number: Column) -> Column:
    return F.concat(hash_, F.when(number > 0, F.concat(F.lit("-"), number.cast("string"))).otherwise(F.lit("")))


def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, a, b): null texts are empty."""
    rows = tuned(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("id", "text", *(key(salt).alias(c) for salt, c in enumerate(KEY)))


def key(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.col("id").isNull(), "id", "text")


def with_forms(rows: DataFrame) -> DataFrame:
    """rows with the canonical form of text, and its hash."""
    return rows.withColumn("form", canonical(F.col("text"))).withColumn("hash", wide_hash(F.col("form")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, group_id, group_size): documents with one canonical form are a group, named by its least id."""
    forms = with_forms(plain(docs, id_col, text_col))
    numbers = number_in_bucket(forms.select("hash", "form"))
    joined = forms.join(numbers, ["hash", "form"], "left").select("id", fingerprint(F.col("hash"), F.coalesce("number", F.lit(0))).alias("fingerprint"))
    groups = joined.groupBy("fingerprint").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    return joined.join(groups, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "group_id", "group_size")


def _few(keys: DataFrame) -> DataFrame:
    """The keys, sent to every task if they are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_HASHES else keys


def next_of(rows: DataFrame) -> DataFrame:
    """(id, a, b, third, n_chars, hash, next_a, next_b, next_hash, times), staged: what follows a document, in descending order of id, after the last the first; times: for how many of its copies.

    rows: (id, a, b, third, n_chars, hash), one for each document, no texts. They
    are numbered by a distributed sort, and each meets the next number by equality.
    """
    order = numbered(rows.withColumn("_place", F.monotonically_increasing_id()), "at", F.desc_nulls_last("id"), *KEY, "_place")
    n = order.count()
    following = order.select(F.pmod(F.col("at") - 1, F.lit(max(1, n))).alias("at"), *(F.col(c).alias(f"next_{c}") for c in (*KEY, "hash")))
    pairs = order.select("id", "at", *KEY, "third", "n_chars", "hash").join(following, "at")
    return staged(pairs.groupBy(*KEY, "next_a", "next_b").agg(*(F.first(c).alias(c) for c in ("id", "third", "n_chars", "hash", "next_hash")), F.count("*").alias("times")), "digest-pairs")


def one_each(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """texts (text, a, b) with one row for each key, of keys that are there several times one row a task being moved."""
    several = pairs.groupBy(*KEY).agg(F.sum("times").alias("n")).filter("n > 1").select(*KEY)
    if not several.limit(1).count():
        return texts
    keys = _few(staged(several, "digest-several"))
    repeated = texts.join(keys, [*KEY], "left_semi").groupBy(*KEY).agg(F.first("text").alias("text")).select(*texts.columns)
    return texts.join(keys, [*KEY], "left_anti").unionByName(repeated)


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    Fingerprints are exact: likeness is 1 for equal canonical forms (compared byte
    by byte where the hashes agree), else 0.
    """
    source = plain(docs, id_col, text_col)
    forms = with_forms(source)
    third = F.floor(F.char_length("text") / 3).cast("int")
    rows = staged(forms.select("id", *KEY, third.alias("third"), F.char_length("text").cast("long").alias("n_chars"), "hash"), "digest-rows")
    numbers = staged(number_in_bucket(forms.select("hash", "form"), rows.select("hash")), "digest-numbers")
    clash = numbers.limit(1).count() > 0
    pairs = next_of(rows)
    texts = one_each(source.select("text", *KEY), pairs)
    # texts are dealt out by their keys: there each gives the beginning that its predecessor asks for, and each gets that of its successor;
    # both use the same columns, so that one exchange serves both
    dealt = texts.repartition(*KEY)
    asked = pairs.select(F.col("next_a").alias("a"), F.col("next_b").alias("b"), *(F.col(c).alias(f"own_{c}") for c in KEY), "id", "third", "n_chars", "hash", "next_hash", "times")
    begun = dealt.join(asked, [*KEY]).withColumn("tail", F.substring(F.col("text"), F.lit(1), F.col("third")))
    begun = begun.select(F.col("own_a").alias("a"), F.col("own_b").alias("b"), F.col("a").alias("next_a"), F.col("b").alias("next_b"), "id", "third", "n_chars", "hash", "next_hash", "times", "tail")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - F.col("third")), F.col("tail"))
    out = dealt.join(begun, [*KEY]).withColumn("edited", edited).withColumn("edited_form", canonical(F.col("edited"))).withColumn("edited_hash", wide_hash(F.col("edited_form")))
    if clash:
        out = out.withColumn("form", canonical(F.col("text")))
        out = out.join(numbers.withColumnRenamed("number", "own"), ["hash", "form"], "left")
        other = numbers.select(F.col("hash").alias("edited_hash"), F.col("form").alias("edited_form"), F.col("number").alias("other"))
        out = out.join(other, ["edited_hash", "edited_form"], "left")
    else:
        out = out.withColumn("own", F.lit(None).cast("int")).withColumn("other", F.lit(None).cast("int"))
    own, other = F.coalesce("own", F.lit(0)), F.coalesce("other", F.lit(0))
    # canonical forms are made anew only where hashes agree; of forms with one hash the fingerprints tell whether the next one's is the same
    like_edited = F.when(F.col("hash") == F.col("edited_hash"), (canonical(F.col("text")) == F.col("edited_form")).cast("double")).otherwise(F.lit(0.0))
    found = out.select(
        "id",
        *KEY,
        "next_a",
        "next_b",
        "times",
        "next_hash",
        F.col("hash").alias("own_hash"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("hash"), own).alias("fingerprint"),
        fingerprint(F.col("edited_hash"), other).alias("edited_fingerprint"),
        like_edited.alias("near_edited"),
    )
    if clash:  # forms that differ in spite of one hash: the next one's fingerprint, by its key
        known = with_forms(texts).join(numbers, ["hash", "form"], "left").select(F.col("a").alias("next_a"), F.col("b").alias("next_b"), fingerprint(F.col("hash"), F.coalesce("number", F.lit(0))).alias("next_fingerprint"))
        found = found.join(known, ["next_a", "next_b"])
        like_next = F.col("fingerprint") == F.col("next_fingerprint")
    else:  # no hash has two forms, as they were compared byte by byte
        like_next = F.col("own_hash") == F.col("next_hash")
    found = found.withColumn("near_next", like_next.cast("double"))
    names = [F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    if not pairs.filter("times > 1").limit(1).count():
        return found.select(*names)
    # the copies of a document that follow one another have one result, given out in steps of bounded size
    step = F.lit(1 << 12)
    parts = found.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / step)))).withColumn("_n", F.least(step, F.col("times") - F.col("_part") * step).cast("int"))
    return parts.repartition(*KEY, "_part").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*names)

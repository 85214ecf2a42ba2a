"""Document fingerprints from the terms that say something about a document.

Terms are the words of a text in lower case. Those in too many documents (as articles are) or in
too few (as slips are) are left out: what remains, the lexicon, is a band of inverse document
frequency. A text's terms in the lexicon, distinct and sorted, are hashed; so are those in each of several
random parts of the lexicon, from half-size parts that react to any change to small ones that most changes
miss. Two texts are as alike as the share of parts, among those where either has a term, in which both have
the same ones. A text without a term in the lexicon, as short ones of rare words are, or copies that make up a large
share of the corpus, is told apart by all its terms instead (by the text itself if it has none): each of its parts has the digest of those.

The lower bound of the band is a share of the documents, so the lexicon is bounded whatever their number: documents have
``d`` distinct terms on average, so at most ``d / LEAST_SHARE`` terms are in that share of them. That
bound makes it safe to broadcast; it is measured all the same, and joined by a shuffle if beyond the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.joins import lookup_join
from quillon.session import stored

TERM = r"[\p{L}\p{N}]+"
LEAST_SHARE = 0.001
MOST_SHARE = 0.1
LEAST_DOCUMENTS = 2
#: Shares of the lexicon's random parts; each but the whole has ``PARTS_OF_EACH`` parts.
SHARES = (1, 4, 16, 64, 256)
PARTS_OF_EACH = 8
N_PARTS = 1 + PARTS_OF_EACH * (len(SHARES) - 1)
_ALWAYS = ""  # stands in every text, in no part: keeps texts without lexicon terms


def terms(text: Column) -> Column:
    """Distinct terms of a text; null has none."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def _drawn(digest: Column, at: int, digits: int) -> Column:
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("long")


def term_key(term: Column) -> Column:
    """A number per term that orders terms, with a bit for each part of the lexicon that has the term.

    ``29`` leading bits are drawn from a digest of the term, and each part's bit is drawn from two hexadecimal digits of further
    digests: set if they are below ``256 / share``.
    """
    first = F.md5(term.cast("binary"))
    key = _drawn(first, 1, 8) % (1 << 29) * (1 << N_PARTS) + 1
    for k, share in enumerate(SHARES[1:]):
        drawn = F.md5(F.concat(term, F.lit(f"|{k}")).cast("binary"))
        for i in range(PARTS_OF_EACH):
            hit = _drawn(drawn, 1 + 3 * i, 3) < 4096 // share
            key = key + F.when(hit, 1 << (1 + PARTS_OF_EACH * k + i)).otherwise(0)
    return key


def lexicon(
    docs: DataFrame, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE, least_documents: int = LEAST_DOCUMENTS,
) -> DataFrame:
    """``term, key`` of the terms whose number of documents lies in the band, counted over all documents."""
    total = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("c"))
    least, most = max(least_documents, least_share * total), max(least_documents, most_share * total)
    return counts.where(F.col("c").between(least, most)).select("term", term_key(F.col("term")).alias("key"))


def fingerprints(texts: DataFrame, words: DataFrame, *ids: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """``ids, fingerprint`` per distinct ``ids`` of ``texts``, a row of binary digests of four bytes.

    ``words`` is a :func:`lexicon`; ``extra`` columns, which ``ids`` settle, are passed through. A part in which a text has no
    term has the digest ``00000000``, but where no part has any, all have that of all terms.
    """
    spark = texts.sparkSession
    always = spark.range(1).select(F.lit(_ALWAYS).alias("term"), F.lit(0).cast("long").alias("key"))
    words = stored(words.unionByName(always).coalesce(8), "lexicon")
    rows = texts.select(*ids, *extra, "text", terms(F.col("text")).alias("terms"))
    rows = rows.select(*ids, *extra, "terms", _plain(F.col("terms"), F.col("text")).alias("plain"))  # before unfolding: no text in a row per term
    rows = rows.select(*ids, *extra, "plain", F.explode(F.concat("terms", F.array(F.lit(_ALWAYS)))).alias("term"))
    found = lookup_join(rows, words, "term").groupBy(*ids).agg(
        F.sort_array(F.collect_list("key")).alias("keys"), F.first("plain").alias("plain"), *[F.first(c).alias(c) for c in extra]
    )
    digests = F.concat(*[_digest(F.expr(f"filter(keys, k -> k & {1 << part}L != 0)")) for part in range(N_PARTS)])
    bare = F.size("keys") == 1  # only the one that stands in every text
    return found.select(*ids, *extra, F.unhex(F.when(bare, F.repeat("plain", F.lit(N_PARTS))).otherwise(digests)).alias("fingerprint"))


def _plain(found: Column, text: Column) -> Column:
    """Eight hexadecimal digits of the digest of all terms, or of a text without any."""
    whole = F.when(F.size(found) > 0, F.array_join(F.array_sort(found), " ")).otherwise(text)
    return F.substring(F.md5(whole.cast("binary")), 1, 8)


def _digest(keys: Column) -> Column:
    """Eight hexadecimal digits of the digest of sorted keys, zeros if there are none."""
    return F.when(F.size(keys) > 0, F.substring(F.md5(keys.cast("string").cast("binary")), 1, 8)).otherwise("00000000")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts, of those where either text has a term; no fingerprint of a text is without any."""
    digests = lambda x: F.regexp_extract_all(F.lower(F.hex(x)), F.lit("[0-9a-f]{8}"), F.lit(0))
    nothing = F.lit("00000000")
    equal = F.zip_with(digests(a), digests(b), lambda x, y: F.when((x != nothing) | (y != nothing), x == y))
    used, same = F.size(F.filter(equal, lambda e: e.isNotNull())), F.size(F.filter(equal, lambda e: e))
    return F.when(used == 0, 1.0).otherwise(same / used)


def next_ids(keys: DataFrame) -> DataFrame:
    """``doc_id, next_id`` for each distinct id: the next smaller one, and for the smallest the largest (nulls are smallest).

    Ids are sorted into ranges, each partition looks inside its own, and the gaps between ranges are
    closed with one row per range.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = keys.select("doc_id").distinct().repartitionByRange(parts, "doc_id")
    ids = stored(ids.withColumn("part", F.spark_partition_id()), "ids")
    inside = Window.partitionBy("part").orderBy("doc_id")
    bounds = ids.groupBy("part").agg(F.max(F.struct("doc_id")).alias("top"))
    before = F.lag("top").over(Window.orderBy("part"))
    last = F.last("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    bounds = bounds.select("part", F.coalesce(before, last).alias("entry"))  # one row per partition
    rows = ids.join(F.broadcast(bounds), "part")
    first = F.row_number().over(inside) == 1
    found = F.when(first, F.col("entry.doc_id")).otherwise(F.lag("doc_id").over(inside))
    return rows.select("doc_id", found.alias("next_id"))


def with_edits(docs: DataFrame) -> DataFrame:
    """Each document's own and edited fingerprint and their likeness to each other and to the next document's.

    ``docs`` has ``doc_id`` (long) and ``text``; other columns are ignored. The edited text has the first half of the text, middle character
    included, then as many characters of the next document's text as are missing, or all it has. The next document is that with the next
    smaller id; after the smallest comes the largest; a null id counts as the smallest. Of several texts of one id the one with the
    smallest hash is the next document. A null text counts as empty; texts without lexicon terms are alike if they have the same terms, or are equal and have none. Rows that repeat both id and text
    come out once. An empty table gives an empty result.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    docs = docs.select(name.alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    keys = stored(docs.groupBy("id", "h").agg(F.count(F.lit(1)).alias("c"), F.max(F.char_length("text").cast("long")).alias("n_chars")), "keys")
    if not keys.where("c > 1").isEmpty():
        docs = docs.dropDuplicates(["id", "h"])
    words = stored(lexicon(docs), "lexicon")
    after = _followers(keys)
    own = stored(fingerprints(docs, words, "id", "h"), "own")
    edited = _edited(docs, keys, after).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    edited = fingerprints(edited, words, "id", "h", extra=("sha",)).withColumnRenamed("fingerprint", "edited")
    firsts = own.join(keys.groupBy("id").agg(F.min("h").alias("h")), ["id", "h"])
    following = after.join(firsts.select(F.col("id").alias("next_id"), F.col("fingerprint").alias("following")), "next_id")
    rows = keys.join(own, ["id", "h"]).join(edited, ["id", "h"]).join(following, "id")
    return rows.select(
        F.when(F.col("id") != "null", F.col("id").cast("long")).alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"),
        F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("following")).alias("near_next"),
    )


def _followers(keys: DataFrame) -> DataFrame:
    """``id, next_id`` as in :func:`next_ids`, for ids as text."""
    ids = next_ids(keys.select(F.when(F.col("id") != "null", F.col("id").cast("long")).alias("doc_id")))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return stored(ids.select(name("doc_id").alias("id"), name("next_id").alias("next_id")), "followers")


def _edited(docs: DataFrame, keys: DataFrame, after: DataFrame) -> DataFrame:
    """``id, h, text`` with the second half of each text replaced by the beginning of the next one.

    Of each text only the first half is sent to the join, and of the next one only what the
    longest text that wants it is missing.
    """
    known = keys.groupBy("id").agg(F.min("h").alias("h"), F.max("n_chars").alias("n"))
    wanted = after.join(known.select("id", "n"), "id").join(known.select(F.col("id").alias("next_id"), "h"), "next_id")
    wanted = stored(wanted.select(F.col("id").alias("wanted_by"), F.col("next_id").alias("id"), "h", "n"), "wanted")
    half = F.floor(F.char_length("text") / 2).cast("int")
    heads = docs.select("id", "h", F.left("text", F.char_length("text") - half).alias("head"), half.alias("missing"))
    tails = lookup_join(docs, wanted, ["id", "h"]).select(
        F.col("wanted_by").alias("id"), F.left("text", F.floor(F.col("n") / 2).cast("int")).alias("tail")
    )
    whole = F.concat("head", F.left("tail", F.col("missing")))
    return heads.join(tails, "id").select("id", "h", whole.alias("text"))

"""Spelling variants: words one inserted, deleted or replaced letter apart, grouped under the common form.

Words with at most one edit agree on all that lies before or behind it. A bucket holds words of some length m, and words
of m + 1, that agree outside a stretch of places in which the edit must be; it begins with either half of a word and
is halved until it is small, so a pair is met in exactly one bucket. Inside a bucket 64 words at a time form a bit-sliced
index: for every place and letter a machine word says which of the 64 have that letter there. A query word goes through the index letter by
letter and keeps the set of words without an error so far and the sets with one error, by replacement and, with places shifted by
one, by insertion; sets are machine words, many queries and blocks are handled by one numpy step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import stored, whole_groups

#: Buckets of more words than this are halved further.
FULL = 4096
#: Pairs of a query and a block in one numpy step, and rows of a task's tables.
STEP = 1 << 15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEAR = "word string, n_near long, near_n long, near string"


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, divisor: int = 199) -> DataFrame:
    """(word, n): words of at least ``least_length`` letters that occur ``least_count`` times.

    A run of letters whose checksum with the doc_id is a multiple of ``divisor`` loses the letter that the checksum names. A null
    text holds no words, a null doc_id counts as an empty one. Words are counted where they lie before they move.
    """
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    rows = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    rows = rows.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % divisor == 0, cut).otherwise(F.col("run"))
    counted = rows.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def _key(word: Column, shift: Column, low: Column, high: Column) -> Column:
    """What a word shows outside its places ``low`` to before ``high``, which end ``shift`` later in the longer of two words."""
    return F.xxhash64(F.col("size"), low, high, F.substring(word, F.lit(1), low), F.lit("|"), word.substr(high + shift + 1, F.length(word)))


def _halved(words: DataFrame) -> DataFrame:
    """Members of buckets from members of wider ones: of places low to before high, either half holds the edit."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("low").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("high").alias("b"))))
    parts = words.withColumn("part", halves)
    low, high = F.col("part.a"), F.col("part.b")
    return parts.select("word", "n", "size", "longer", low.alias("low"), high.alias("high"), _key(F.col("word"), F.col("longer"), low, high).alias("key"))


def sliced(letters: np.ndarray, block: np.ndarray, bit: np.ndarray, blocks: int, place: int) -> np.ndarray:
    """Per block and letter the set of its words with that letter at ``place``, as bits of one machine word."""
    out = np.zeros((blocks, 256), np.uint64)
    if 0 <= place < letters.shape[1]:
        np.bitwise_or.at(out, (block, letters[:, place]), bit)
    return out


def near_masks(queries: np.ndarray, letters: np.ndarray, longer: np.ndarray, block: np.ndarray, bit: np.ndarray, blocks: int, pairs: tuple[np.ndarray, np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sets of words near to a query, one for every pair of a query and a block of the index.

    ``queries`` are words of m letters, ``letters`` of the index m letters with a 0 behind them or m + 1. ``zero``
    holds words that agree so far, ``replaced`` those with one replaced letter, ``inserted`` those with one letter more, which are
    held against the query's letter one place on. A near word belongs to the bucket whose places, low to before high,
    hold the first place at which the two words part.
    """
    q, s = pairs
    m = queries.shape[1]
    full = np.zeros(blocks, np.uint64)
    np.bitwise_or.at(full, block, bit)
    more = np.zeros(blocks, np.uint64)
    np.bitwise_or.at(more, block[longer], bit[longer])
    zero = full[s]
    replaced, inserted = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64)
    at_low, at_high = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64)
    here = sliced(letters, block, bit, blocks, 0)
    for i in range(m + 1):
        at_low = np.where(low == i, zero, at_low)
        at_high = np.where(high == i, zero, at_high)
        # A longer word may have its extra letter at this place.
        inserted |= zero
        if i == m:
            break
        after = sliced(letters, block, bit, blocks, i + 1)
        c = queries[q, i]
        agree = here[s, c]
        replaced = (replaced & agree) | (zero & ~agree)
        inserted &= after[s, c]
        zero &= agree
        here = after
    return ((replaced & ~more[s]) | (inserted & more[s])) & at_low & ~at_high


def _bits(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the mask, number of the bit) of every bit set."""
    at = np.nonzero(masks)[0]
    flags = np.unpackbits(masks[at].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(flags)
    return at[row], bit


def _lettered(words: list[str], width: int) -> np.ndarray:
    """Code points of words, one row each, zeros behind; letters are below 256."""
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("latin-1"), np.uint8).reshape(len(words), width)


def near_in_buckets(word: list[str], n: np.ndarray, size: np.ndarray, longer: np.ndarray, low: np.ndarray, high: np.ndarray, bucket: np.ndarray):
    """(first, second): places of near words of every bucket; rows of a bucket stand together."""
    firsts, seconds = [], []
    for m in np.unique(size).tolist():
        rows = np.nonzero(size == m)[0]
        start = np.nonzero(np.diff(bucket[rows], prepend=-1))[0]
        counts = np.diff(np.append(start, len(rows)))
        # Blocks of 64 words; buckets begin anew.
        inside = np.arange(len(rows)) - np.repeat(start, counts)
        block_of = np.cumsum((inside % 64 == 0)) - 1
        blocks = int(block_of[-1]) + 1
        first_block = np.repeat(block_of[start], counts)
        in_bucket = np.repeat(-(-counts // 64), counts)
        lead = np.nonzero(longer[rows] == 0)[0]
        per = in_bucket[lead]
        ends = np.cumsum(per)
        # As many query words at a time as make STEP pairs, and their blocks.
        begin = 0
        while begin < len(lead):
            done = ends[begin] - per[begin]
            stop = max(begin + 1, int(np.searchsorted(ends, done + max(1, STEP * 16 // (m + 16)), "right")))
            some = lead[begin:stop]
            a, b = int(first_block[some[0]]), int((first_block[some] + in_bucket[some]).max())
            members = np.arange(np.searchsorted(block_of, a), np.searchsorted(block_of, b))
            letters = _lettered([word[r] for r in rows[members].tolist()], m + 1)
            q = np.repeat(np.arange(len(some)), in_bucket[some])
            s = np.arange(len(q)) - np.repeat(np.cumsum(in_bucket[some]) - in_bucket[some], in_bucket[some]) + np.repeat(first_block[some], in_bucket[some]) - a
            bit = np.uint64(1) << (inside[members] % 64).astype(np.uint64)
            queries = letters[some - members[0], :m]
            masks = near_masks(queries, letters, longer[rows[members]] == 1, block_of[members] - a, bit, b - a, (q, s), low[rows[some]][q], high[rows[some]][q])
            pair, place = _bits(masks)
            first_of_block = np.searchsorted(block_of, np.arange(a, b))
            x, y = rows[some[q[pair]]], rows[first_of_block[s[pair]] + place]
            # Two words of one length meet from both sides; from the other side they are counted below.
            once = (longer[y] == 1) | (x < y)
            firsts.append(x[once])
            seconds.append(y[once])
            begin = stop
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(firsts), np.concatenate(seconds)


def _compare(batches):
    """Per word of a bucket: how many near words it has there, and the most frequent of them."""
    import pyarrow as pa

    for rows, bucket in whole_groups(batches, 1):
        word = rows.column("word").to_pylist()
        n, size, longer, low, high = (rows.column(c).to_numpy() for c in ("n", "size", "longer", "low", "high"))
        # Keys are hashes: buckets that share one are told apart by their places here, and by their letters in the index.
        order = np.lexsort((low, size, bucket))
        word = [word[i] for i in order.tolist()]
        n, size, longer, low, high, bucket = (c[order] for c in (n, size, longer, low, high, bucket))
        bucket = np.cumsum((np.diff(bucket, prepend=-1) != 0) | (np.diff(size, prepend=-1) != 0) | (np.diff(low, prepend=-1) != 0))
        x, y = near_in_buckets(word, n, size, longer, low, high, bucket)
        if not len(x):
            continue
        me, other = np.concatenate([x, y]), np.concatenate([y, x])
        names = np.array(word, object)
        # The most frequent first, of equals the first by code points.
        rank = np.empty(len(word), np.int64)
        rank[np.array(sorted(range(len(word)), key=lambda i: (-n[i], word[i])), np.int64)] = np.arange(len(word))
        order = np.lexsort((rank[other], me))
        me, other = me[order], other[order]
        start = np.nonzero(np.diff(me, prepend=-1))[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[me[start]], pa.string()), pa.array(np.diff(np.append(start, len(me)))), pa.array(n[other[start]]), pa.array(names[other[start]], pa.string())],
            ["word", "n_near", "near_n", "near"],
        )


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of every word with a near one: how many, and of the most frequent its count and itself.

    Equal counts go by code points. Words are distinct and made of code points below 256. Buckets are halved until they hold at most ``FULL`` words; one of a single place can't
    hold more than every letter there, so no bucket grows with the data.
    """
    length = F.length("word")
    wide = words.select("word", "n", F.explode(F.array(F.struct(length.alias("size"), F.lit(0).alias("longer")), F.struct((length - 1).alias("size"), F.lit(1).alias("longer")))).alias("r"))
    wide = wide.select("word", "n", "r.size", "r.longer", F.lit(0).alias("low"), (F.col("r.size") + 1).alias("high"))
    found = None
    while True:
        members = stored(_halved(wide), "variants")
        held = members.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.max(F.col("high") - F.col("low")).alias("places")).where("held > 1")
        small = (F.col("held") <= FULL) | (F.col("places") == 1)
        fitting = members.join(held.where(small).select("key"), "key").repartition("key").sortWithinPartitions("key")
        some = stored(fitting.select("key", "word", "n", "size", "longer", "low", "high").mapInArrow(_compare, NEAR), "near")
        found = some if found is None else found.unionByName(some)
        large = stored(held.where(~small).select("key"), "large")
        if large.isEmpty():
            break
        wide = members.join(large, "key").drop("key")
    best = F.max_by(F.struct("near_n", "near"), F.struct("near_n", _reversed(F.col("near"))))
    grouped = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return grouped.select("word", "n_near", "best.near_n", "best.near")


def _reversed(word: Column) -> Column:
    """Letters of a word as numbers counted down, with the end above all: larger for words first by code points."""
    letters = F.transform(F.split(word, ""), lambda c: -F.ascii(c))
    return F.concat(letters, F.array(F.lit(1)))


def spelling_forms(docs: DataFrame, times: int = 5) -> DataFrame:
    """One row per word of ``docs``: word, n, n_near, form, form_n, root; what a word is says ``word_counts``.

    The form is the most frequent near word if it is at least ``times`` as frequent; forms are
    followed to the last by doubling, each round stored. A table without words gives no rows.
    """
    words = stored(word_counts(docs), "words")
    near = stored(near_words(words), "near")
    named = words.join(near, "word", "left")
    fits = F.col("near_n") >= times * F.col("n")
    named = named.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n"))
    named = stored(named, "forms")
    # Counts grow five times a step, so a chain is short, and doubling ends after a few rounds.
    steps = named.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = stored(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if steps.where("moved").isEmpty():
            break
        steps = steps.drop("moved")
    out = named.join(steps.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql() -> str:
    """The same by all words with one letter left out."""
    from tallywatch.llm.common import crc32_sql

    table, crc = crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")
    letters = "a-zÀ-ÿ"
    return f"""
    WITH RECURSIVE crc AS (SELECT {table} AS crc_table),
    r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[{letters}]{{6,}}')) AS run FROM documents WHERE text IS NOT NULL),
    h AS (SELECT run, {crc} AS h FROM r, crc),
    w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h),
    v AS (SELECT word, count(*) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
    d AS (SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM v, range(1, length(word) + 1) t(i)),
    p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word != b.word
          UNION SELECT a.word, b.word, b.n FROM v a JOIN d b ON a.word = b.rest
          UNION SELECT b.word, a.word, a.n FROM v a JOIN d b ON a.word = b.rest),
    b AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM p GROUP BY word),
    f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n
          FROM v LEFT JOIN b ON b.word = v.word),
    c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f AS l ON l.word = c.at AND l.form IS NULL"""

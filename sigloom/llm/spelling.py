"""Spelling variants grouped under their frequent form, by bands of letter-parity masks.

Words are counted over all texts. Two words are near if they differ by exactly one inserted, deleted or replaced code point;
a word's form is its near word of the largest count (ties: the smallest in code-point order), if that count is at least
`ratio` times the word's. Its root is where the forms lead; counts grow along them, so they end.

Candidates. A word's mask has a bit for each letter, set if the letter occurs an odd number of times (rarer letters share
bits). One edit flips at most two bits, so of three bands of the mask at least one stays equal:

* an inserted or deleted letter flips one bit: lengths differ by one and two of the bands are equal;
* a replaced letter flips none or two: lengths are equal, and either both bits lie in one band and the other two bands are
  equal, or they lie in two bands and one band is equal, while in each of the others one bit differs.

Words are joined on these equal bands and the length, in the last case also on the parity of a second band, which tells the two
sides apart; at most two different bits pass, and the edit distance decides. A pair counts in the first band that finds it. Words of
a band that many share are dealt in blocks of BLOCK words, each of which meets the whole other side. The candidates of a band grow
with the square of the words in it, that is of the vocabulary and not of the texts; the counting before it combines in each task.

Defined cases: a null or empty text has no words, and a null id is written as nothing. Repeated rows count again. An empty table
gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import release, staged

#: What a word is made of, and the letters in the order of their frequency in European text.
RUN = r"[A-Za-zÀ-ÿ]+"
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OTHERS, BANDS, BLOCK = 38, 3, 4096
MIN_CHARS, MIN_COUNT, RATIO, SLIP = 6, 5, 5, 199


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, slip: int | None = None) -> DataFrame:
    """word, n: the runs of letters, A-Z lower-cased, of at least min_chars code points, over all texts.

    With `slip`, a run of which the crc32 of `<id>:<run>` is divisible by it loses the code point at that crc32 modulo its length.
    """
    text = F.translate(F.col(text_col).cast("string"), UPPER, UPPER.lower())
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("word"))
    runs = runs.where(F.char_length("word") >= min_chars)
    if slip is not None:
        crc = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (crc % F.char_length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        runs = runs.select(F.when(crc % slip == 0, cut).otherwise(F.col("word")).alias("word")).where(F.char_length("word") >= min_chars)
    return runs.groupBy("word").agg(F.count("*").alias("n"))


def band_of(bit: int) -> int:
    """Bits are dealt to the bands there and back again, so that each has frequent and rare letters."""
    place, turn = bit % BANDS, bit // BANDS % 2
    return BANDS - 1 - place if turn else place


def bit_of(letter: str) -> int:
    at = LETTERS.find(letter)
    return at if at >= 0 else len(LETTERS) + ord(letter) % OTHERS


#: Of each code point up to U+00FF that a word can have, its bit as a 64-bit number; 0 for all others.
_LETTER_BITS = [0 if not (chr(c) in LETTERS or c >= 0xC0 or 65 <= c <= 90) else (1 << bit_of(chr(c))) - (1 << 64 if bit_of(chr(c)) == 63 else 0) for c in range(256)]
_BAND_MASKS = [reduce(lambda m, bit: m | 1 << bit, (k for k in range(64) if band_of(k) == b), 0) for b in range(BANDS)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def mask(word: Column) -> Column:
    """The letter-parity mask, 64 bits."""
    bits = F.array(*(F.lit(x).cast("long") for x in _LETTER_BITS))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.get(bits, F.ascii(c))))


def _sides(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of either side of the join: the kind of key, its value and length, and the word with its mask.

    Kinds 0 to 2 have one band, 3 to 5 all but one. The left side asks for words of its own length, in kinds 3 to 5 also for longer ones.
    """
    known = vocabulary.select("word", mask(F.col("word")).alias("mask"), F.char_length("word").alias("chars"))
    left, right = [], []
    for b in range(BANDS):
        band, others, next_band = (_signed(m) for m in (_BAND_MASKS[b], (1 << 64) - 1 ^ _BAND_MASKS[b], _BAND_MASKS[(b + 1) % BANDS]))
        odd = F.bit_count(F.col("mask").bitwiseAND(next_band)) % 2 == 1

        def key(kind: int, value: Column, length: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), F.col("mask").bitwiseAND(value).alias("value"), length.alias("length"))

        one, two = key(b, band, F.col("chars")), key(BANDS + b, others, F.col("chars"))
        left += [F.when(~odd, one), two, key(BANDS + b, others, F.col("chars") + 1)]
        right += [F.when(odd, one), two]
    return tuple(known.select("word", "mask", "chars", F.explode(F.array(*keys)).alias("k")).where("k IS NOT NULL").select("k.*", "word", "mask", "chars") for keys in (left, right))


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """a, b: the pairs of words (distinct) of an edit distance of one, each once."""
    left, right = _sides(vocabulary)
    key = ["kind", "value", "length"]
    parts = left.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias("parts")).where("parts > 1")
    parts = staged(parts, "parts")
    dealt = left.join(parts, key, "left").select(*key, F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int").alias("block"), *(F.col(c).alias(f"{c}_a") for c in ("word", "mask", "chars")))
    every = right.join(parts, key, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    every = every.select(*key, "block", *(F.col(c).alias(f"{c}_b") for c in ("word", "mask", "chars")))
    flips = F.bit_count(F.col("mask_a").bitwiseXOR(F.col("mask_b")))
    # In kinds 3 to 5 words of one length meet in both orders; those of equal masks meet in all three kinds.
    once = (F.col("kind") < BANDS) | (F.col("chars_a") < F.col("chars_b")) | ((F.col("word_a") < F.col("word_b")) & ((F.col("kind") == BANDS) | (flips > 0)))
    met = dealt.join(every, [*key, "block"]).where((flips <= 2) & once)
    return met.where(F.levenshtein("word_a", "word_b", 1) == 1).select(F.col("word_a").alias("a"), F.col("word_b").alias("b"))


def variants(counts: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words (word, n) of at least min_count occurrences."""
    vocabulary = staged(counts.where(F.col("n") >= min_count).select("word", "n"), "vocabulary")
    pairs = staged(near_pairs(vocabulary), "near")
    links = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("x")).select("x.*")
    best = links.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    held = F.col("near_n") >= ratio * F.col("n")
    known = vocabulary.join(best.select("word", "n_near", "best.near", (-F.col("best.less")).alias("near_n")), "word", "left")
    known = staged(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(held, F.col("near")).alias("form"), F.when(held, F.col("near_n")).alias("form_n")), "forms")
    roots = staged(known.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not roots.where("moved").isEmpty():
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("up"))
        further = staged(roots.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        release(roots)
        roots = further
    found = known.join(roots.select("word", "root"), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = None) -> DataFrame:
    """The variants among the words of all texts."""
    return variants(words(docs, id_col, text_col, slip=slip))


ORACLE = """
WITH RECURSIVE r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[A-Za-z' || chr(192) || '-' || chr(255) || ']+')) AS w FROM documents),
o AS (SELECT id, w, count(*) AS n FROM r WHERE length(w) >= 6 GROUP BY id, w),
c AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(hex(encode(id || ':' || w)), '..'), lambda b:
         [(strpos('0123456789ABCDEF', b[1]) - 1) * 16 + strpos('0123456789ABCDEF', b[2]) - 1, 0, 0, 0, 0, 0, 0, 0]))),
         lambda x, e: xor(xor(x, e) >> 1, 3988292384 * (xor(x, e) & 1)))) AS crc FROM o),
e AS (SELECT CASE WHEN crc % 199 = 0 THEN w[:crc % length(w)] || w[crc % length(w) + 2:] ELSE w END AS word, n FROM c),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
d AS (SELECT DISTINCT word, word[:i - 1] || word[i + 1:] AS less FROM k),
near AS (
  SELECT a.word, b.word AS near FROM k a JOIN k b ON a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word) AND a.word[:a.i - 1] || '_' || a.word[a.i + 1:] = b.word[:b.i - 1] || '_' || b.word[b.i + 1:]
  UNION SELECT d.word, v.word FROM d JOIN v ON d.less = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.less = v.word),
b AS (SELECT near.word, count(*) AS n_near, first(near.near ORDER BY v.n DESC, encode(near.near)) AS near, max(v.n) AS near_n FROM near JOIN v ON near.near = v.word GROUP BY near.word),
f AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN b ON v.word = b.word),
up AS (SELECT word, word AS root, form AS next, 0 AS steps FROM f UNION ALL SELECT up.word, f.word, f.form, steps + 1 FROM up JOIN f ON up.next = f.word)
SELECT f.word, f.form, u.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN up u ON u.word = f.word AND u.next IS NULL
"""

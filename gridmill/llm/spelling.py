"""Words and their spelling variants: a frontier of states walks a trie of the vocabulary, level by level.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. The trie's edges are a table
(depth, parent, character, child); a node's number is the hash of its prefix. A state says that the first
``position`` characters of a word have led to a node with so many edits. Words that share their first characters share
their states, so a word and position are kept as the word's own trie node, and a state without edits is a node itself. What the
frontier holds are the states with one edit:

* a replacement leads from a node to two of its children;
* an insertion leads from a node to a child of another character, and on with the word's next character (so that a letter put in beside
  its like counts once); at the end of a word any child will do;
* a deletion is an insertion seen from the other word, and a replacement is taken from the smaller character only.

Each level is two joins with the edge table: the word's next edge, and the same character from the other node. States whose both nodes
end a word make neighbours. A node has at most as many children as there are letters, and the states of a node lie within one
edit of it, so no key of these joins can be hot. Levels are written to the shared folder.

The trie holds words of up to ``LEVELS`` characters. Longer ones are compared by hashes of what is left without one character.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.functions.joins import small_side
from gridmill.functions.semantics import col, require
from gridmill.llm.common import written
from gridmill.llm.pieces import slices

RUN = "[a-zÀ-ÿ]+"
LEAST_LENGTH = 5
LEAST_COUNT = 3
LEVELS = 64
HELD = 200_000  # words that a task counts before it passes its counts on
_PRIME = (1 << 61) - 1


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, slip: int | None = None) -> DataFrame:
    """(word, n): the runs of letters of all texts with at least ``least`` code points, A to Z lower-cased.

    With ``slip``, variants are planted: a run loses the code point h % length where ``slip`` divides h, the crc32 of ``<key>:<run>``; a null
    key reads as empty. A null or empty text has no word. Texts are read whole; a task holds about ``HELD`` words.
    """
    require(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        from collections import Counter
        from zlib import crc32

        find, held = re.compile(RUN).findall, Counter()

        def passed_on() -> pa.RecordBatch:
            words = {w: n for w, n in held.items() if n}
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                for name, t in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found = [w for w in find(t.encode().lower().decode()) if len(w) >= least] if t else []
                    held.update(found)
                    if slip:
                        start = crc32(f"{name or ''}:".encode())
                        for w in set(found):
                            h = crc32(w.encode(), start)
                            if h % slip == 0:
                                n, at = found.count(w), h % len(w)
                                held[w] -= n
                                if len(w) > least:
                                    held[w[:at] + w[at + 1 :]] += n
                    if len(held) >= HELD:
                        yield passed_on()
        if held:
            yield passed_on()

    named = docs.select(col(key).cast("string").alias("key"), col(text).alias("text"))
    return named.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def edge_table(words: DataFrame) -> DataFrame:
    """(depth, p, c, ch, ends): edges of the trie of ``word``, from nodes ``depth`` characters deep; ``ends`` if the child is a word."""
    word, d = F.col("word"), F.col("depth")
    steps = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("depth"))
    return (
        steps.groupBy(
            "depth", F.xxhash64(F.substring(word, F.lit(1), d)).alias("p"), F.ascii(F.substring(word, d + 1, F.lit(1))).alias("c"),
            F.xxhash64(F.substring(word, F.lit(1), d + 1)).alias("ch"),
        )
        .agg(F.max(d + 1 == F.length("word")).alias("ends"))
    )


def _edges(edges: DataFrame, side: str) -> DataFrame:
    return edges.select(*[F.col(c).alias(f"{side}_{c}") for c in ("depth", "p", "c", "ch", "ends")])


def first_edits(edges: DataFrame) -> DataFrame:
    """(depth, u, v, done): the states just after their edit; ``u``, the word's node, lies ``depth`` characters deep."""
    a, b, f = (_edges(edges, x) for x in "abf")
    siblings = a.join(b, (F.col("a_p") == F.col("b_p")) & (F.col("a_depth") == F.col("b_depth")) & (F.col("a_c") != F.col("b_c")))
    replaced = siblings.filter("a_c < b_c").select((F.col("a_depth") + 1).alias("depth"), F.col("a_ch").alias("u"), F.col("b_ch").alias("v"), F.expr("a_ends AND b_ends").alias("done"))
    inserted = siblings.join(f, (F.col("b_ch") == F.col("f_p")) & (F.col("a_c") == F.col("f_c"))).select(
        (F.col("a_depth") + 1).alias("depth"), F.col("a_ch").alias("u"), F.col("f_ch").alias("v"), F.expr("a_ends AND f_ends").alias("done")
    )
    last = a.filter("a_ends").join(b.filter("b_ends"), F.col("a_ch") == F.col("b_p"))
    # one more character at the word's end: nothing follows, so depth 0 keeps it out of the walk
    appended = last.select(F.lit(0).alias("depth"), F.col("a_ch").alias("u"), F.col("b_ch").alias("v"), F.lit(True).alias("done"))
    return replaced.unionByName(inserted).unionByName(appended)


def short_pairs(words: DataFrame) -> DataFrame:
    """(u, v): hashes of near words, each pair once, among words of at most ``LEVELS`` characters."""
    spark = words.sparkSession
    edges = written(edge_table(words), "trie-edges")
    fresh = written(first_edits(edges), "trie-edits")
    deepest = edges.agg(F.max("depth")).first()[0] or 0
    found, front = [fresh.filter("done")], fresh.filter("depth = 1")
    for depth in range(1, deepest + 1):
        a, b = _edges(edges.filter(F.col("depth") == depth), "a"), _edges(edges.filter(F.col("depth").between(depth, depth + 1)), "b")
        moved = front.join(a, F.col("u") == F.col("a_p")).join(b, (F.col("v") == F.col("b_p")) & (F.col("a_c") == F.col("b_c")))
        level = written(moved.select(F.col("a_ch").alias("u"), F.col("b_ch").alias("v"), F.expr("a_ends AND b_ends").alias("done")), f"trie-level-{depth + 1}")
        found.append(level.filter("done"))
        front = level.select("u", "v").unionByName(fresh.filter(F.col("depth") == depth + 1).select("u", "v"))
    return functools.reduce(DataFrame.unionByName, [x.select("u", "v") for x in found], spark.createDataFrame([], "u bigint, v bigint"))


def long_pairs(words: DataFrame) -> DataFrame:
    """(u, v): hashes of near words, each pair once, by the hashes of a word without each of its characters; rows follow a word's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, word in zip(batch.column("number").to_pylist(), batch.column("word").to_pylist(), strict=True):
                codes, n = [ord(x) + 1 for x in word], len(word)
                base, powers, heads = 0x5851F42D4C957F2D % _PRIME, [1], [0]
                for x in codes:
                    powers.append(powers[-1] * base % _PRIME)
                    heads.append((heads[-1] * base + x) % _PRIME)
                # the hash of the word without its k-th character: what comes before, moved up, and what comes after
                without = [(heads[k] * powers[n - k - 1] + heads[n] - heads[k + 1] * powers[n - k - 1]) % _PRIME for k in range(n)]
                rows = [(number, n, k, h) for k, h in enumerate(without)]  # alike but for the k-th
                rows += [(number, n - 1, -2, h) for h in set(without)] + [(number, n, -1, heads[n])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["number", "length", "kind", "code"])

    rows = written(words.select(F.xxhash64("word").alias("number"), "word").mapInArrow(run, "number bigint, length bigint, kind bigint, code bigint"), "long-words")
    a = rows.select(F.col("number").alias("u"), "length", "kind", "code")
    b = rows.select(F.col("number").alias("v"), "length", "kind", "code")
    replaced = a.filter("kind >= 0").join(b, ["length", "kind", "code"]).filter("u < v").select("u", "v")
    inserted = a.filter("kind = -1").drop("kind").join(b.filter("kind = -2").drop("kind"), ["length", "code"]).select("u", "v")
    return replaced.unionByName(inserted)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each near pair of a vocabulary (word, n) of distinct words, in both directions.

    Pairs found by hashes are held against the words themselves.
    """
    length = F.length("word")
    known = words.select("word", "n")
    pairs = short_pairs(known.filter((length <= LEVELS) & (length > 0)))
    if not (long := known.filter(length >= LEVELS)).isEmpty():
        # words of LEVELS characters are in both
        pairs = pairs.unionByName(long_pairs(long)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    u = known.select(F.xxhash64("word").alias("u"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    v = known.select(F.xxhash64("word").alias("v"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    named = pairs.join(u, "u").join(v, "v").filter(F.levenshtein("a", "b", 1) == 1)
    named = written(named.select("a", "a_n", "b", "b_n"), "near-words")
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    return named.select(F.explode(sides).alias("s")).select("s.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms that starts at each word ends. ``forms`` (word, form) has no cycle; chains are followed in doubled steps."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        if now.join(ahead, F.col("root") == F.col("_w"), "left_semi").isEmpty():
            return now
        now = written(now.join(ahead, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root")), "spelling-roots")


def grouped(words: DataFrame, times: int = 2) -> DataFrame:
    """One row for each word of a vocabulary (word, n): form, root, n_near, form_n.

    ``form`` is the near word of largest n, the smallest in code-point order among ties, if that n is at least ``times`` the word's own (``times`` is 2 or more, so
    chains end); ``root`` follows forms to the last. A word without a near word has n_near 0, no form, and is its own root. Rows with
    a null word are left out, equal words are counted together, and other columns play no part. An empty vocabulary gives an empty result.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    require(words, "word", "n")
    once = written(words.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("bigint").alias("n")), "vocabulary")
    best = near_words(once).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"),
    )
    joined = once.join(best, "word", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    found = written(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")),
        "spelling-forms",
    )
    ends = small_side(roots(found.filter("form IS NOT NULL").select("word", "form")))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int | None = None, least: int = LEAST_LENGTH, often: int = LEAST_COUNT) -> DataFrame:
    """``grouped`` over the words of all texts with at least ``least`` code points and ``often`` occurrences; see ``counts`` for ``slip``."""
    return grouped(counts(docs, key, text, least, slip).filter(F.col("n") >= often))


#: The same rows in DuckDB. It has no crc32, so a table of the byte steps is made first.
SQL = """
WITH RECURSIVE step AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i)) AS t
),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
),
named AS (
  SELECT run, count(*) AS m, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run
),
bytes AS (
  SELECT run, m, list_transform(range(length(x) // 2), lambda i: ((instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT) AS b FROM named
),
hashed AS (
  SELECT run, m, xor(list_reduce(b, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM bytes, step
),
vocabulary AS MATERIALIZED (
  SELECT word, sum(m)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3
),
cuts AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
),
near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM vocabulary a JOIN cuts b ON a.word = b.rest
  UNION SELECT b.word, b.n, a.word, a.n FROM vocabulary a JOIN cuts b ON a.word = b.rest
),
best AS (
  SELECT word, n, count(*) AS n_near, max(other_n) AS top, min(other) FILTER (WHERE other_n = most) AS other
  FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS most FROM near) GROUP BY word, n
),
forms AS MATERIALIZED (SELECT word, other AS form, top AS form_n FROM best WHERE top >= 2 * n),
chain AS (
  SELECT word, form AS step FROM forms
  UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON chain.step = forms.word
),
ends AS (SELECT word, step FROM chain WHERE step NOT IN (SELECT word FROM forms))
SELECT v.word, f.form, coalesce(e.step, v.word) AS root, v.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM vocabulary v LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word) LEFT JOIN ends e USING (word)
"""

"""Phrase collocations from a weighted de Bruijn graph of words.

Every word starts one gram: the longest of at most ``LONGEST`` words that fits into its piece. A gram of full length is
an edge between two overlapping nodes of one word less; a shorter one stands at the end of a piece, where a node has
flow but no edge. Edges and ends are counted once, in tasks and then by a shuffle. All shorter counts follow from the
flow of nodes: a phrase occurs as often as its longer prolongations together and as often as pieces end with it. Edges
of candidates are compacted to unary paths (a node is unary if the flow into it and out of it each is one edge's), by
pointer doubling; the candidates of full length are read off the paths.

Before that a sieve breaks pieces where no candidate can lie: between two words whose pair occurs fewer than ``least``
times. It is an array of bits over hashes of pairs that occur often enough, of at most 2 ** ``SIEVE_MOST`` bits
whatever the data's size. What it lets through wrongly is only more work; counts never come from it.

Defined results: a null text is empty, a null language is ``und``; an empty table or one without candidates gives no
rows; repeated rows and repeated doc_ids count like any other; further columns aren't read. Words and pieces may be of
any length; long texts are taken in slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specula.llm.common import drop_written, partitions, table, written

LONGEST = 4
SIEVE_MOST = 27
#: Bytes of text that are split into words at once, and words that are counted at once.
SLICE, COUNTED = 1 << 20, 1 << 18
#: Separators of pieces become a word that no text can hold, letters A-Z small ones.
_END = b"."
_TO = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")


def _slices(text: bytes):
    """Parts of at most about SLICE bytes that end where a word does."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            ends = [k for k in (text.find(b" ", end), text.find(_END, end)) if k >= 0]
            end = min(ends) if ends else len(text)
        yield text[at:end]
        at = end


class _Words:
    """Words as numbers, 0 for an end of a piece; forgotten after each count."""

    def __init__(self) -> None:
        self.texts: list[bytes] = []
        self.bytes = 0
        self.ids: list[np.ndarray] = []
        self.known: dict[bytes, int] = {_END: 0}
        self.n = 0

    def add(self, part: bytes) -> None:
        """Take a part that ends where a word does."""
        self.texts.append(part)
        self.bytes += len(part)
        if self.bytes >= SLICE:
            self.split()

    def split(self) -> None:
        d = pa.array(b"".join(self.texts).replace(_END, b" . ").split(b" "), pa.binary()).dictionary_encode()
        here = np.array([self.known.setdefault(w, len(self.known)) if w else -1 for w in d.dictionary.to_pylist()], np.int64)
        ids = here[d.indices.to_numpy()]
        self.ids.append(ids[ids >= 0])
        self.n += len(self.ids[-1])
        self.texts, self.bytes = [], 0

    def take(self, open_: bool = False) -> tuple[np.ndarray, list[bytes], int]:
        """Numbers of the words, the words, and how many of the numbers are to count. Within a text the last few are kept for the next time."""
        self.split()
        ids, words = np.concatenate([*self.ids, np.zeros(1 - open_, np.int64)]), list(self.known)
        self.__init__()
        starts = max(len(ids) - LONGEST + 1, 0) if open_ else len(ids)
        if open_:
            self.ids = [np.array([self.known.setdefault(words[k], len(self.known)) for k in ids[starts:]], np.int64)]
            self.n = len(ids) - starts
        return ids, words, starts


def _counted(batches):
    """(language, numbers, words, numbers to count) of about COUNTED words of one language."""
    held: dict[str, _Words] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            for text, lang in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), strict=True):
                if text:
                    w = held.setdefault(lang, _Words())
                    for s in _slices(text.translate(_TO)):
                        if w.n >= COUNTED:
                            yield lang, *w.take(open_=True)
                        w.add(s)
                    w.add(_END)
                    if w.n >= COUNTED:
                        yield lang, *held.pop(lang).take()
            while sum(w.n * 8 + w.bytes for w in held.values()) > 32 * SLICE:  # many languages
                lang = max(held, key=lambda k: held[k].n * 8 + held[k].bytes)
                yield lang, *held.pop(lang).take()
    for lang, w in held.items():
        yield lang, *w.take()


def _pair_hashes(lang: str, ids: np.ndarray, words: list[bytes]) -> np.ndarray:
    """A hash for each place and the next, of language and both words; 0 where a piece ends."""
    own = np.array([xxhash.xxh3_64_intdigest(w, len(lang)) for w in words], np.uint64)
    seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    a, b = own[ids[:-1]], own[ids[1:]]
    h = (a ^ seed) * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(31)) | (b >> np.uint64(33)))
    h ^= h >> np.uint64(29)
    h = (h * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
    return np.where((ids[:-1] > 0) & (ids[1:] > 0), h, np.uint64(0))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def frequent_pairs(docs: DataFrame, least: int) -> DataFrame:
    """h, hashes of the pairs of neighbours that occur ``least`` times or more, and of few others."""

    def run(batches):
        for lang, ids, words, starts in _counted(batches):
            h = _pair_hashes(lang, ids, words)[:starts]
            found, n = np.unique(h[h > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["h", "n"])

    return _rows(docs).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")


def _bits(pairs: DataFrame) -> bytes:
    """The sieve: a bit for each hash, 16 bits or more a pair up to 2 ** SIEVE_MOST in all."""
    size = min(max((pairs.count() * 16).bit_length(), 16), SIEVE_MOST)
    at = F.shiftrightunsigned("h", 64 - size)
    word = pairs.groupBy(F.shiftrightunsigned(at, 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int"))).alias("b"))
    out = np.zeros(1 << (size - 6), np.int64)
    rows = word.toArrow()  # at most 2 ** (SIEVE_MOST - 6) rows, whatever the data's size
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out.tobytes()


def edges(docs: DataFrame, least: int = 30, longest: int = LONGEST) -> DataFrame:
    """lang, gram, k (its words), n: how often a gram of at most ``longest`` words starts where no longer one fits.

    Pieces are broken between words that the sieve knows to be rare together.
    """
    pairs = written(frequent_pairs(docs, least), "frequent-pairs")
    sieve = docs.sparkSession.sparkContext.broadcast(_bits(pairs))
    drop_written(pairs)

    def run(batches):
        bits = np.frombuffer(sieve.value, np.uint64)
        shift = np.uint64(64 - (len(bits) * 64).bit_length() + 1)
        for lang, ids, words, starts in _counted(batches):
            h = _pair_hashes(lang, ids, words)
            at = h >> shift
            on = (h > 0) & ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1)
            on = np.append(on, False)
            size = np.ones(len(ids), np.int64)  # words of the gram at each place
            reach = on
            for step in range(1, longest):
                size += reach
                reach = reach & np.append(on[step:], np.zeros(step, bool))
            ahead = np.stack([np.where(size > d, np.append(ids[d:], np.zeros(d, np.int64)), 0) for d in range(longest)] + [np.zeros(len(ids), np.int64)] * (LONGEST - longest))
            use = np.flatnonzero(ids[:starts] > 0)
            ahead, size = ahead[:, use], size[use]
            if not len(size):
                continue
            both, half = np.unique(np.stack([ahead[0] * len(words) + ahead[1], ahead[2] * len(words) + ahead[3]]), return_inverse=True)
            half = half.reshape(2, -1)
            _, first, n = np.unique(half[0] * len(both) + half[1], return_index=True, return_counts=True)
            for at in range(0, len(first), 20_000):
                some = first[at : at + 20_000]
                grams = [b" ".join([words[w] for w in g if w]) for g in ahead[:, some].T.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams, pa.binary()).cast(pa.string()), pa.array(size[some].astype(np.int32)), pa.array(n[at : at + 20_000])], names=["lang", "gram", "k", "n"])

    made = _rows(docs).mapInArrow(run, "lang string, gram string, k int, n bigint")
    return made.groupBy("lang", "gram").agg(F.first("k").alias("k"), F.sum("n").alias("n"))


def _first(phrase: str, k: int):
    return F.substring_index(phrase, " ", k)


def _rest(phrase: str):
    """All words but the first."""
    return F.expr(f"substring({phrase}, instr({phrase}, ' ') + 1)")


def flows(graph: DataFrame, longest: int = LONGEST) -> list[DataFrame]:
    """For k = 1 to ``longest``: lang, phrase, f of all phrases of k words, from the flow of those of k + 1 and the ends."""
    of = [graph.where(f"k = {longest}").select("lang", F.col("gram").alias("phrase"), F.col("n").alias("f"))]
    for k in range(longest - 1, 0, -1):
        out = of[0].select("lang", _first("phrase", k).alias("phrase"), "f")
        ends = graph.where(f"k = {k}").select("lang", F.col("gram").alias("phrase"), F.col("n").alias("f"))
        of.insert(0, out.unionAll(ends).groupBy("lang", "phrase").agg(F.sum("f").alias("f")))
    return of


def unary_paths(full: DataFrame, nodes: DataFrame) -> DataFrame:
    """lang, words (array) and f of the maximal unary paths over ``full``'s edges; ``nodes`` has the flow of their nodes.

    Two edges follow each other if each is all the flow of the node between them. A piece that enters a circle starts
    or ends somewhere, so no path closes. Pointers to the edge before double until all point at a path's first edge.
    """
    edge = full.select("lang", "phrase", "f", F.expr("substring_index(phrase, ' ', size(split(phrase, ' ')) - 1)").alias("tail"), _rest("phrase").alias("head"))
    node = nodes.withColumnRenamed("phrase", "node").withColumnRenamed("f", "flow")
    into = edge.select("lang", F.col("head").alias("node"), F.col("phrase").alias("before"), F.col("f").alias("flow"))
    single = into.join(node, ["lang", "node", "flow"]).select("lang", F.col("node").alias("tail"), F.col("flow").alias("f"), "before")
    now = edge.join(single, ["lang", "tail", "f"], "left")
    now = written(now.select("lang", "phrase", "f", F.coalesce("before", "phrase").alias("at"), F.col("before").isNotNull().cast("bigint").alias("steps")), "paths")
    while True:
        to = now.select("lang", F.col("phrase").alias("at"), F.col("at").alias("to"), F.col("steps").alias("more"))
        new = written(now.join(to, ["lang", "at"]).select("lang", "phrase", "f", F.col("to").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")), "paths")
        drop_written(now)
        done = new.where("moved").isEmpty()
        now = new.drop("moved")
        if done:
            break
    last = F.substring_index("phrase", " ", -1)
    path = now.groupBy("lang", F.col("at").alias("start")).agg(F.first("f").alias("f"), F.array_sort(F.collect_list(F.struct("steps", last.alias("word")))).alias("more"))
    return path.select("lang", F.concat(F.split("start", " "), F.slice(F.col("more.word"), F.lit(2), F.size("more"))).alias("words"), "f")


def windows(paths: DataFrame, k: int) -> DataFrame:
    """lang, phrase, f of the phrases of k words along paths."""
    at = F.sequence(F.lit(1), F.size("words") - (k - 1))
    return paths.select("lang", F.explode(F.transform(at, lambda i: F.array_join(F.slice("words", i, k), " "))).alias("phrase"), "f")


def collocations(docs: DataFrame, least: int = 30, inside: int = 80, scale: int = 2_000_000, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, k, a, l, r, score, n (words of the language) of all phrases of 2 to ``longest`` words that occur ``least`` times or more.

    Every cut into two parts scores floor(scale * a / (l + r)); the lowest counts, at ties the earliest. Phrases inside
    a longer candidate that occurs at least ``inside`` percent as often are dropped: it is enough to ask those one word
    longer, for any longer one is no more frequent than one between.
    """
    graph = written(edges(docs, least, longest), "word-graph")
    words = written(graph.groupBy("lang").agg(F.sum("n").alias("n")), "words")  # every word starts one gram
    known = [written(f.where(F.col("f") >= least), f"phrases-{k}") for k, f in enumerate(flows(graph, longest), 1)]
    drop_written(graph)
    found = [known[k - 1].select("lang", "phrase", F.col("f").alias("a"), F.lit(k).alias("k")) for k in range(2, longest)]
    full = known[-1]
    if longest > 2:
        full = windows(unary_paths(full, known[-2]), longest)
    found.append(full.select("lang", "phrase", F.col("f").alias("a"), F.lit(longest).alias("k")))
    every = written(_union(found), "candidates")
    longer = every.where("k > 2").select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), _rest("phrase"))).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = every.join(longer, ["lang", "phrase"], "left").where(f"around IS NULL OR 100 * around < {inside} * a").drop("around")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at")
    cuts = kept.select("*", cut).select("*", F.expr("substring_index(phrase, ' ', at)").alias("left"), F.expr("substring_index(phrase, ' ', at - k)").alias("right"))
    parts = _union(known[:-1])
    of = lambda side, to: parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(to))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    # decimals of 38 digits: counts of 64 bits times the scale stay exact
    score = F.expr(f"CAST(CAST(a AS DECIMAL(20, 0)) * CAST({scale} AS DECIMAL(12, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0))) AS BIGINT)")
    lowest = F.min(F.struct(score.alias("score"), "at", "l", "r")).alias("x")
    scored = cuts.groupBy("lang", "phrase", "k", "a").agg(lowest).select("lang", "phrase", "k", "a", "x.l", "x.r", "x.score")
    return scored.join(words, "lang")


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionAll(df)
    return out


def first_of_each(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language by score, a and phrase, with their rank.

    First those of each share of a language, as many shares as partitions; then of 16 shares, so that the last task of a
    language gets 16 * ``top`` rows at most.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    out = scored
    for shares in (max(partitions(scored), 16), 16, 1):
        within = Window.partitionBy("lang", "_share").orderBy(*order)
        out = out.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(shares))).withColumn("rank", F.row_number().over(within).cast("bigint")).where(F.col("rank") <= top)
    return out.drop("_share")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_of_each(collocations(table(spark, sf_dir, "documents")), 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: Every phrase is counted by itself, every cut and every longer phrase is looked at.
SQL = """WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, row_number() OVER () AS id, piece FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
w AS (SELECT lang, id, unnest(w) AS a, generate_subscripts(w, 1) AS place FROM (SELECT lang, id, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p)),
next AS (SELECT lang, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d FROM w WINDOW o AS (PARTITION BY id ORDER BY place)),
g AS (SELECT lang, 1 AS k, a AS phrase FROM next UNION ALL SELECT lang, 2, a || ' ' || b FROM next WHERE b IS NOT NULL
UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM next WHERE c IS NOT NULL UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d FROM next WHERE d IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3), n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
part AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS around FROM c, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS j) WHERE j < k AND i + j - 1 <= k GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN part USING (lang, phrase) WHERE around IS NULL OR 100 * around < 80 * a),
cut AS (SELECT kept.lang, kept.phrase, a, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score, i FROM kept, (SELECT unnest([1, 2, 3]) AS i)
JOIN f l ON l.lang = kept.lang AND l.phrase = array_to_string(w[1:i], ' ') JOIN f r ON r.lang = kept.lang AND r.phrase = array_to_string(w[i + 1:kept.k], ' ') WHERE i < kept.k),
best AS (SELECT lang, phrase, a, l, r, score FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM best JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""

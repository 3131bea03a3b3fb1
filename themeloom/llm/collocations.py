"""Word collocations from a weighted de Bruijn graph.

Texts are split into pieces and these into words. Nodes of the graph are neighbouring word pairs,
edges are three words in a row (the longest phrases), from the first pair to the second, which
overlap by a word. Every word begins one row: an edge, or what is left of a piece at its end, a
pair or a word without a follower. A worker counts equal rows of a bounded chunk of texts and sends
them in compressed blocks, dealt by the hash of the row, as most rows of a corpus are seen once; a
hot pair or word is thus spread over all blocks, and what they sum for it is one row each.

Shorter counts are node flow: a pair's count is the sum of the edges that leave it and of the
piece ends at it; a word's count is the sum over its pairs and of the pieces that end with it. A
pair is unary where one edge brings all its occurrences and one takes them on. Paths of edges
through unary pairs are compacted by pointer doubling, in rounds that grow with the logarithm of
the longest path, into one row with its words and its one count; such paths come from passages that
repeat. No path closes to a ring, as the piece that enters it starts or joins somewhere. Paths
counted less often than the least count hold no phrase and are left out, after their share of the
flow is taken.

Phrases are read from the paths: every three words in a row of a path, and the pairs between
paths. Unary pairs inside a path occur as often as the three words around them and are never
reported, since a longer phrase with ``share`` percent of their count drops them. Scores are exact,
in decimals.

Cases: null texts have no words; a null language is ``und``; repeated rows count each; ties are
ordered by count, then phrase; languages without a phrase and empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import table
from themeloom.runtime import cut

LEAST, SHARE, TOP = 10, 50, 2000
#: Words whose rows are counted together by a worker, at least those of one text; bytes of text
#: whose rows meet in one block group.
CHUNK, GROUP_BYTES = 1_500_000, 4 << 20
#: Piece ends become line feeds, A-Z lower case.
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r", bytes(range(97, 123)) + b"\n" * 9)
_BLOCK = "lang string, part int, x binary, y binary, z binary, n binary"
_KEYS = ["lang", "node"]


# Words travel with a line feed at their end, a missing one as the line feed alone, so that a column
# of words is one text.


def _strings(text: bytes) -> pa.Array:
    data = np.frombuffer(text, np.uint8)
    ends = np.r_[0, np.flatnonzero(data == 10) + 1].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(text))


def _hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words.to_pylist()], np.uint64)


def _dealt(lang: str, words: list[pa.Array], hashes: list[np.ndarray], codes: list[np.ndarray], n: np.ndarray, parts: int):
    """Blocks of rows of coded words, by the hash of the row."""
    mixed = np.zeros(len(n), np.uint64)
    for h, c in zip(hashes, codes):
        mixed = (mixed ^ h[c]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    part = (mixed % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.r_[0, np.flatnonzero(np.diff(part[order])) + 1, len(order)] if len(order) else np.zeros(1, int)
    pack, columns = zstandard.ZstdCompressor(3).compress, []
    for w, c in zip(words, codes):
        laid = w.take(pa.array(c[order]))
        ends = np.frombuffer(laid.buffers()[1], np.int64)
        data = memoryview(laid.buffers()[2] or b"")
        columns.append([pack(data[ends[i] : ends[j]]) for i, j in zip(cuts[:-1], cuts[1:])])
    columns += [[None] * (len(cuts) - 1)] * (3 - len(columns))
    columns.append([pack(n[order[i:j]].astype("<i8").tobytes()) for i, j in zip(cuts[:-1], cuts[1:])])
    own = part[order][cuts[:-1]].tolist()
    return {"lang": [lang] * len(own), "part": own} | dict(zip("xyzn", columns))


def _summed(blocks: pa.Table, names: str) -> tuple[list[pa.Array], list[np.ndarray], np.ndarray]:
    """Words, codes and sums of the distinct rows of blocks, in order of the codes."""
    unpack = zstandard.ZstdDecompressor().decompress
    n = np.concatenate([np.frombuffer(unpack(b), "<i8") for b in blocks["n"].to_pylist()])
    words, codes = [], []
    for name in names:
        coded = pa.concat_arrays([_strings(unpack(b)) for b in blocks[name].to_pylist()]).dictionary_encode()
        words.append(coded.dictionary)
        codes.append(coded.indices.to_numpy().astype(np.int64))
    order = np.lexsort(codes[::-1])
    codes = [c[order] for c in codes]
    new = np.any([np.r_[True, np.diff(c) != 0] for c in codes], axis=0)
    return words, [c[new] for c in codes], np.add.reduceat(n[order], np.flatnonzero(new))


def _counted(texts: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of numbered words, and their counts; number 0 is a piece end."""
    seq = np.concatenate([*texts, np.zeros(2, np.int64)])
    a, b, c = seq[:-2], seq[1:-1], seq[2:]
    c = np.where(b > 0, c, 0)
    at = a > 0
    pair, back = np.unique(a[at] * size + b[at], return_inverse=True)
    gram, n = np.unique(back * size + c[at], return_counts=True)
    pair, last = pair[gram // size], gram % size
    return [pair // size, pair % size, last], n


def graph_blocks(docs: DataFrame, parts: int, chunk: int = CHUNK) -> DataFrame:
    """Blocks of rows: edges, and piece ends with missing words. Equal rows are in equal parts."""

    def run(batches):
        texts: dict[str, list] = {}
        number: dict[bytes, int] = {b".": 0}
        held = 0

        def flush():
            words = pa.array([b"\n", *(w + b"\n" for w in list(number)[1:])], pa.large_binary()).cast(pa.large_string())
            hashes = _hashes(words)
            for lang, mine in texts.items():
                codes, n = _counted(mine, len(words))
                yield pa.RecordBatch.from_pydict(_dealt(lang, [words] * 3, [hashes] * 3, codes, n, parts), _SCHEMA)

        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"]):
                own = (text.as_py() or "").encode().translate(_FOLD).replace(b"\n", b" . ").split()
                for w in dict.fromkeys(own):
                    number.setdefault(w, len(number))
                ids = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
                texts.setdefault("und" if lang is None else lang, []).append(np.append(ids, 0))
                held += len(own)
                if held >= chunk:
                    yield from flush()
                    texts, number, held = {}, {b".": 0}, 0
                    pa.default_memory_pool().release_unused()
        yield from flush()

    need = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    return need.mapInArrow(run, _BLOCK)


_SCHEMA = pa.schema([("lang", pa.string()), ("part", pa.int32()), *((c, pa.binary()) for c in "xyzn")])
_FOUND = pa.schema([("node", pa.string()), ("next", pa.string()), ("f", pa.int64())])
_BOTH = f"{_BLOCK}, node string, next string, f long"


def _found(words: list[pa.Array], codes: list[np.ndarray], n: np.ndarray, at: np.ndarray):
    """Rows (node, next, f) of the places ``at``; the last of three words is the next one."""
    each = [[w[:-1] for w in w.take(pa.array(c[at])).to_pylist()] for w, c in zip(words, codes)]
    node = [" ".join(x) for x in zip(*each[:2])]
    return {"node": node, "next": each[2] if len(each) > 2 else [None] * len(node), "f": n[at]}


def _table(lang: str, rows: dict, blocks: dict | None = None) -> pa.Table:
    found = pa.table(rows, _FOUND)
    for name in ("lang", *_SCHEMA.names[1:]):
        kind = _SCHEMA.field(name).type
        found = found.append_column(name, pa.array([lang] * len(found), kind) if name == "lang" else pa.nulls(len(found), kind))
    parts = [found]
    if blocks:
        made = pa.table(blocks, _SCHEMA)
        parts.append(made.append_column("node", pa.nulls(len(made), pa.string())).append_column("next", pa.nulls(len(made), pa.string())).append_column("f", pa.nulls(len(made), pa.int64())))
    order = [f.split()[0] for f in _BOTH.split(", ")]
    return pa.concat_tables([p.select(order) for p in parts])


def flows(docs: DataFrame, least: int, chunk: int = CHUNK, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, f), pairs (lang, node, f) and edges (lang, node, next, n, f), with f the
    flow of the node; pairs and edges of at least the least count."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = total // group_bytes + 1

    def of_edges(key, blocks):
        """Sums of equal rows: edges of the least count, and the flow that the rows give their pairs."""
        lang = key[0].as_py()
        words, codes, n = _summed(blocks, "xyz")
        heavy = np.flatnonzero((n >= least) & (codes[2] != _missing(words[2])))
        first = np.r_[True, (np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0)]
        flow = np.add.reduceat(n, np.flatnonzero(first))
        blocks = _dealt(lang, words[:2], [_hashes(w) for w in words[:2]], [c[first] for c in codes[:2]], flow, parts)
        return _table(lang, _found(words, codes, n, heavy), blocks)

    def of_pairs(key, blocks):
        """Flow of pairs: those of the least count, and the flow that they give their first words."""
        lang = key[0].as_py()
        words, codes, n = _summed(blocks, "xy")
        heavy = np.flatnonzero((n >= least) & (codes[1] != _missing(words[1])))
        first = np.flatnonzero(np.r_[True, np.diff(codes[0]) != 0])
        rows = {"node": [w[:-1] for w in words[0].take(pa.array(codes[0][first])).to_pylist()], "next": [""] * len(first), "f": np.add.reduceat(n, first)}
        return pa.concat_tables([_table(lang, rows), _table(lang, _found(words, codes, n, heavy))])

    key = ["lang", "part"]
    one = cut(graph_blocks(docs, parts, chunk).groupBy(*key).applyInArrow(of_edges, _BOTH))
    two = cut(one.where("part IS NOT NULL").groupBy(*key).applyInArrow(of_pairs, _BOTH).select(*_KEYS, "next", "f"))
    words = cut(two.where("next IS NOT NULL").groupBy("lang", F.col("node").alias("word")).agg(F.sum("f").alias("f")))
    pairs = two.where("next IS NULL").select(*_KEYS, "f")
    edges = one.where("part IS NULL").select(*_KEYS, "next", F.col("f").alias("n"))
    return words, pairs, edges.join(pairs, _KEYS)


def _missing(words: pa.Array) -> int:
    return words.index("\n").as_py()


def _last_pair(words: Column) -> Column:
    return F.concat_ws(" ", F.element_at(words, -2), F.element_at(words, -1))


def compacted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths (lang, first, words, n, f of the first pair) and the unary pairs (lang, node) inside them."""
    gram = F.concat_ws(" ", "node", "next")
    e = edges.select("lang", "node", "next", "n", "f", gram.alias("gram"))
    head = F.concat_ws(" ", F.substring_index("node", " ", -1), "next")
    into = e.select("lang", head.alias("node"), F.col("n").alias("f"), F.col("gram").alias("before"))
    # one edge brings all occurrences of the pair and this one takes them all on
    after = e.where("n = f").join(into, ["lang", "node", "f"]).select("lang", "gram", "node", "before")
    linked = e.join(after.drop("node"), ["lang", "gram"], "left")
    state = cut(
        linked.select(
            "lang", "gram", "next", "n", "f", F.coalesce("before", "gram").alias("up"),
            F.col("before").isNotNull().cast("int").alias("steps"), F.col("before").isNotNull().alias("open"),
        )
    )
    inner = state.where("steps = 1").select("lang", F.substring_index("gram", " ", 2).alias("node"))
    while not state.where("open").isEmpty():
        above = state.select("lang", F.col("gram").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("open").alias("_open"))
        moved = state.where("open").join(above, ["lang", "up"]).select(
            "lang", "gram", "next", "n", "f", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_open").alias("open")
        )
        state = cut(moved.unionByName(state.where("NOT open")))
    tail = F.transform(F.array_sort(F.collect_list(F.struct("steps", "next"))), lambda x: x["next"])
    first = F.max(F.when(F.col("steps") == 0, F.col("f"))).alias("f")
    paths = state.groupBy("lang", "up").agg(tail.alias("tail"), F.first("n").alias("n"), first)
    node = F.substring_index("up", " ", 2)
    words = F.concat(F.split(node, " "), F.col("tail"))
    return cut(paths.select("lang", node.alias("first"), words.alias("words"), "n", "f")), inner


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two and three words of each language.

    a, l and r are the counts of the phrase and of the two parts of its lowest-scoring cut, n the
    words of the language. ``share``: the percentage of a pair's count, at most 100, from which a
    longer phrase around it drops it.
    """
    if not 0 < share <= 100:
        raise ValueError("share is a percentage above 0")
    words, pairs, edges = flows(docs, least, chunk)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    paths, inner = compacted(edges)
    last = paths.select("lang", _last_pair(F.col("words")).alias("node"), "first", "words", "n", F.col("f").alias("f_first"))
    whole = last.join(pairs.withColumnRenamed("f", "f_last"), _KEYS)
    place = F.explode(F.sequence(F.lit(1), F.size("words") - 2)).alias("i")
    threes = whole.select("*", place).select(
        "lang",
        F.slice("words", F.col("i"), 3).alias("w"),
        F.col("n").alias("a"),
        F.when(F.col("i") == 1, F.col("f_first")).otherwise(F.col("n")).alias("f12"),
        F.when(F.col("i") == F.size("words") - 2, F.col("f_last")).otherwise(F.col("n")).alias("f23"),
    )
    around = paths.select("lang", F.col("first").alias("node"), "n").unionByName(last.select(*_KEYS, "n"))
    around = around.groupBy(*_KEYS).agg(F.max("n").alias("most"))
    twos = (
        pairs.join(inner, _KEYS, "left_anti")
        .join(around, _KEYS, "left")
        .where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("f")))
        .select("lang", F.split("node", " ").alias("w"), F.col("f").alias("a"))
    )
    f = words.where(F.col("f") >= least)
    phrases = threes.unionByName(twos, allowMissingColumns=True)
    for name, at in (("f_head", 1), ("f_tail", -1)):
        of = f.select("lang", F.col("word").alias("_w"), F.col("f").alias(name))
        phrases = phrases.withColumn("_w", F.element_at("w", at)).join(of, ["lang", "_w"]).drop("_w")

    def part(left: str, right: str) -> Column:
        wide = {c: f"CAST({c} AS DECIMAL(15, 0))" for c in ("a", left, right)}
        score = f"(CAST(1000000 AS DECIMAL(7, 0)) * {wide['a']} * {wide['a']}) div ({wide[left]} * {wide[right]})"
        return F.struct(F.expr(score).alias("score"), F.lit(1 if left == "f_head" else 2).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    lowest = F.when(F.col("f12").isNull(), part("f_head", "f_tail")).otherwise(F.least(part("f_head", "f23"), part("f12", "f_tail")))
    scored = phrases.select("lang", F.array_join("w", " ").alias("phrase"), "a", lowest.alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
ones AS (SELECT lang, w[i] AS p, count(*) AS f FROM places GROUP BY ALL),
twos AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM places WHERE i < len(w) GROUP BY ALL),
threes AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM places WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM ones GROUP BY lang),
around AS (
  SELECT lang, x, y, max(f) AS f FROM (
    SELECT lang, x, y, f FROM threes UNION ALL SELECT lang, y, z, f FROM threes) GROUP BY ALL),
cuts AS (
  SELECT t.lang, t.x || ' ' || t.y AS phrase, 1 AS k, t.f AS a, l.f AS l, r.f AS r
  FROM twos t JOIN ones l ON l.lang = t.lang AND l.p = t.x JOIN ones r ON r.lang = t.lang AND r.p = t.y
  LEFT JOIN around o ON o.lang = t.lang AND o.x = t.x AND o.y = t.y
  WHERE t.f >= 10 AND (o.f IS NULL OR 100 * o.f < 50 * t.f)
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, 1, t.f, l.f, r.f
  FROM threes t JOIN ones l ON l.lang = t.lang AND l.p = t.x JOIN twos r ON r.lang = t.lang AND r.x = t.y AND r.y = t.z
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, 2, t.f, l.f, r.f
  FROM threes t JOIN twos l ON l.lang = t.lang AND l.x = t.x AND l.y = t.y JOIN ones r ON r.lang = t.lang AND r.p = t.z),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank FROM lowest)
JOIN total USING (lang) WHERE rank <= 2000
"""


def query(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))

"""Ranked lexical search: the best documents of each item, by a dual-tree search.

A document is a sparse vector of term impacts, an item one of term weights,
and a score is their inner product.  The items of a block stand in a tree, and
so do the documents of a batch; each node holds the coordinate maxima of what
is below it.  The inner product of two nodes' maxima is then an upper bound of
every score between them.  If it is less than the weakest k-th score that the
items below the one node have so far, no document below the other can enter
any of their lists, and the pair of nodes is left out whole.  This is exact.

Items come to the driver in blocks of bounded size (``BLOCK_ITEMS`` rows and
about ``BLOCK_BYTES`` of text); all rows of documents are read for each block,
once for the statistics of the block's terms and once for the search.  A task
keeps k rows an item, and Spark ranks what the tasks send.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrix.llm import flat
from attrix.llm.shared import materialize, pick, ship_code

TOP = 10
BLOCK_ITEMS = 1024
BLOCK_BYTES = 1 << 23
#: Bytes of text, documents and matrix cells that a task holds at once.
BATCH_BYTES, BATCH_DOCS, BATCH_CELLS = 1 << 22, 1024, 1 << 22
LEAF, FAN = 16, 8
#: Lists of so many groups of tasks are ranked before the last ranking.
SALTS = 64
#: Scores under this are whole numbers in a double.
EXACT = float(1 << 53)
MAX_IMPACT = 1_000_000

_TERM = np.zeros(256, dtype=bool)
_TERM[0x30:0x3A] = _TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True


# ---------------------------------------------------------------- terms
def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts end to end (bytes, A-Z lower-cased), and the text that each is in."""
    body, off = flat.flat(column)
    member = _TERM[body]
    starts, ends = flat.runs(member, off)
    found = flat.spans(flat.LOWER[body], member, starts, ends)
    return found, np.searchsorted(off, starts, "right") - 1


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def document_vectors(column: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each text, and (text, term, count) of the vocabulary's terms, sorted by text."""
    found, owner = terms(column)
    n = np.bincount(owner, minlength=len(column)).astype(np.int64)
    at = pc.fill_null(pc.index_in(found, value_set=vocabulary), -1).to_numpy()
    known = at >= 0
    size = max(len(vocabulary), 1)
    pairs, counts = np.unique(owner[known].astype(np.int64) * size + at[known], return_counts=True)
    return n, pairs // size, pairs % size, counts


def impacts(counts: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Saturated counts, less in long documents: whole numbers under MAX_IMPACT."""
    m = np.array([25 + 75 * size * n_docs // n_terms for size in n.tolist()], dtype=np.int64)
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


# ---------------------------------------------------------------- trees
class ItemTree:
    """Items by their rarest term in leaves of LEAF; a node has the terms below it and their largest weights.

    ``rows`` has the weights of each item's terms; items without one are left out.
    """

    def __init__(self, rows: list[dict[int, int]], df: np.ndarray):
        rarest = {i: min(row, key=lambda t: (df[t], t)) for i, row in enumerate(rows) if row}
        self.items = np.array(sorted(rarest, key=rarest.get), dtype=np.int64)
        self.levels: list[list[tuple[int, int, np.ndarray, np.ndarray]]] = []
        self.leaves: list[tuple[np.ndarray, np.ndarray, bool]] = []
        nodes = []
        for a in range(0, len(self.items), LEAF):
            mine = self.items[a : a + LEAF]
            cols = np.array(sorted({t for i in mine.tolist() for t in rows[i]}), dtype=np.int64)
            place = {t: k for k, t in enumerate(cols.tolist())}
            table = np.zeros((len(mine), len(cols)), dtype=np.int64)
            for k, i in enumerate(mine.tolist()):
                for t, w in rows[i].items():
                    table[k, place[t]] = w
            exact = float(table.sum(axis=1).max()) * MAX_IMPACT < EXACT
            self.leaves.append((mine, table.astype(np.float64) if exact else table, exact))
            nodes.append((a, a + len(mine), cols, table.max(axis=0).astype(np.float64)))
        self.levels.append(nodes)
        while len(nodes) > 1:
            above = []
            for k in range(0, len(nodes), FAN):
                below = nodes[k : k + FAN]
                cols, place = np.unique(np.concatenate([b[2] for b in below]), return_inverse=True)
                high = np.zeros(len(cols))
                np.maximum.at(high, place, np.concatenate([b[3] for b in below]))
                above.append((below[0][0], below[-1][1], cols, high))
            self.levels.append(nodes := above)


class DocumentTree:
    """Documents of a batch as rows of a matrix, and the maxima of each LEAF rows, each FAN leaves, and so on."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.levels = []
        rows, width = matrix, LEAF
        while True:
            rows = np.maximum.reduceat(rows, np.arange(0, len(rows), width), axis=0)
            self.levels.append(rows)
            if len(rows) == 1:
                return
            width = FAN

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The nodes of the next lower level; rows, under level 0."""
        width, most = (FAN, len(self.levels[level - 1])) if level else (LEAF, len(self.matrix))
        under = (nodes[:, None] * width + np.arange(width)).ravel()
        return under[under < most]


class Lists:
    """The best TOP (score, id) of each item so far; ``kth`` is the score that another row must reach."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.kth = np.ones(n_items)  # a score of 0 is no match
        self.rows: dict[int, tuple] = {}

    def add(self, leaf: int, items: np.ndarray, scores: np.ndarray, ids: tuple[np.ndarray, np.ndarray]) -> None:
        """``scores`` (documents x items of a leaf); ``ids`` is (is null, id) of the documents."""
        doc, item = np.nonzero(scores >= self.kth[items])
        if not len(doc):
            return
        parts = [(items[item], scores[doc, item].astype(np.int64), ids[0][doc], ids[1][doc])]
        if leaf in self.rows:
            parts.insert(0, self.rows[leaf])
        who, score, absent, id_ = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((id_, absent, -score, who))
        who, score, absent, id_ = who[order], score[order], absent[order], id_[order]
        first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        rank = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        last = rank == self.top - 1
        self.kth[who[last]] = score[last]
        best = rank < self.top
        self.rows[leaf] = who[best], score[best], absent[best], id_[best]


def search(items: ItemTree, docs: DocumentTree, ids: tuple[np.ndarray, np.ndarray], lists: Lists) -> int:
    """Bring the documents into the items' lists; returns the scores computed."""
    scored = 0

    def visit(height: int, k: int, level: int, nodes: np.ndarray) -> None:
        nonlocal scored
        a, b, cols, high = items.levels[height][k]
        bound = docs.levels[level][np.ix_(nodes, cols)].astype(np.float64) @ high
        weakest = lists.kth[items.items[a:b]].min()
        # a sum of doubles may fall short by its rounding
        open_ = bound * (1 + 1e-9) >= weakest
        nodes, bound = nodes[open_], bound[open_]
        if not len(nodes):
            return
        if level:
            under = docs.below(level, nodes)
            if height:
                for c in range(k * FAN, min(k * FAN + FAN, len(items.levels[height - 1]))):
                    visit(height - 1, c, level - 1, under)
            else:
                visit(0, k, level - 1, under)
            return
        if height:
            for c in range(k * FAN, min(k * FAN + FAN, len(items.levels[height - 1]))):
                visit(height - 1, c, 0, nodes)
            return
        who, table, exact = items.leaves[k]
        best_first = nodes[np.argsort(-bound, kind="stable")]
        for i in range(0, len(best_first), LEAF):
            some = best_first[i : i + LEAF]
            if i:  # the lists have grown since
                some = some[docs.levels[0][np.ix_(some, cols)].astype(np.float64) @ high * (1 + 1e-9) >= lists.kth[who].min()]
                if not len(some):
                    return
            rows = docs.below(0, some)
            part = docs.matrix[np.ix_(rows, cols)]
            scores = part.astype(np.float64 if exact else np.int64) @ table.T
            scored += scores.size
            lists.add(k, who, scores, (ids[0][rows], ids[1][rows]))

    if len(items.items):
        visit(len(items.levels) - 1, 0, len(docs.levels) - 1, np.arange(1))
    return scored


# ---------------------------------------------------------------- Spark
def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most BATCH_BYTES of text and ``most`` rows, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
        ends = np.cumsum(sizes)
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BATCH_BYTES, "right"))
            j = min(max(j, i + 1), i + most)
            yield batch.slice(i, j - i)
            i = j


def term_statistics(docs: DataFrame, vocabulary: pa.Array) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        df = np.zeros(len(vocabulary), np.int64)
        for batch in _slices(batches, 1 << 16):
            n, _, term, _ = document_vectors(batch.column("text"), vocabulary)
            n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
            df += np.bincount(term, minlength=len(df))
        held = np.flatnonzero(df)
        numbers, values = [-2, -1, *held.tolist()], [n_docs, n_terms, *df[held].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(values, pa.int64())], names=["term", "n"])

    # a row a term of the block, whose size is bounded
    got = {r["term"]: r["n"] for r in docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.array([got.get(t, 0) for t in range(len(vocabulary))], dtype=np.int64)
    return got.get(-2, 0), got.get(-1, 0), df


def _sortable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(is null, value) arrays that sort like the ids do in Spark."""
    absent = column.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(column.type):
        return absent, pc.fill_null(column, 0).to_numpy()
    return absent, np.array(pc.fill_null(column, "").to_pylist(), dtype=str)


def _ranked_block(docs: DataFrame, items: list, top: int) -> DataFrame:
    """part, no, doc_id, score: the best rows of each task for the items (no, text) of a block."""
    found, owner = terms(pa.array([r["text"] for r in items], pa.large_string()))
    vocabulary = found.unique()
    n_docs, n_terms, df = term_statistics(docs, vocabulary)
    rows: list[dict[int, int]] = [{} for _ in items]
    for i, t in zip(owner.tolist(), pc.index_in(found, value_set=vocabulary).to_pylist()):
        if df[t]:
            rows[i][t] = rows[i].get(t, 0) + weight(n_docs, int(df[t]))
    tree = ItemTree(rows, df)
    numbers = np.array([r["no"] for r in items], dtype=np.int64)
    most = min(BATCH_DOCS, max(LEAF, BATCH_CELLS // max(len(vocabulary), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, id_type = Lists(len(rows), top), None
        for batch in _slices(batches, most):
            id_type = batch.column("doc_id").type
            n, doc, term, counts = document_vectors(batch.column("text"), vocabulary)
            if not len(doc):
                continue
            # documents with the same rarest term lie together
            order = np.lexsort((term, df[term], doc))
            first = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
            hit = doc[first][np.argsort(term[first], kind="stable")]
            row_of = np.zeros(batch.num_rows, dtype=np.int64)
            row_of[hit] = np.arange(len(hit))
            matrix = np.zeros((len(hit), len(vocabulary)), dtype=np.float32)  # impacts are whole and less than 2**24
            matrix[row_of[doc], term] = impacts(counts, n[doc], n_docs, n_terms)
            absent, ids = _sortable(batch.column("doc_id"))
            search(tree, DocumentTree(matrix), (absent[hit], ids[hit]), lists)
        for who, score, absent, id_ in lists.rows.values():
            ids = pa.array(id_.tolist(), id_type, mask=absent)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[who]), ids, pa.array(score)], names=["no", "doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"no long, doc_id {kind}, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with a score above 0.

    Highest scores first, equal ones by ascending doc_id, then rows without an
    id; rows that repeat an id are documents of their own, in any order among
    equals.  Items that repeat or have no id are ranked each on its own.  Null
    and empty texts, of items too, have no terms and so no matches; empty
    tables give an empty result; other columns are ignored.  Ids that are not
    whole numbers are read as strings.
    """
    spark = docs.sparkSession
    ship_code(spark)
    rows = pick(docs, doc_id=id_col, text=text_col)
    whole = isinstance(rows.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    rows = rows.select(F.col("doc_id").cast("long" if whole else "string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = pick(items, item_id=item_col, text=item_text_col).select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = materialize(asked.withColumn("no", F.monotonically_increasing_id()), "ranking-items")
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    found = None
    for k in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("no"), F.lit(blocks)) == k).select("no", "text").collect()
        part = _ranked_block(rows, block, top).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        found = part if found is None else found.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["no", "salt"], ["no"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    named = found.join(asked.select(F.col("no").alias("item_no"), "item_id"), F.col("no") == F.col("item_no"))
    return named.select("item_id", "rank", "doc_id", "score")


SQL = """
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id
), total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, total
), qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL
), s AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN len USING (doc_id), total GROUP BY item_id, doc_id
), r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""

"""Spelling variants: words one edit apart, found in a trie of letter counts.

Letters fall into groups; a word's path in the trie is its length, then how many of its letters belong to
the first group, to the second, and so on. One inserted, deleted or replaced letter changes a path by at
most one letter too many (surplus) and one too few (deficit). A search goes down the trie depth first with
a budget of one each: to the child with its own count, to the next higher one for the surplus, to the next
lower one for the deficit. Words at the leaves it reaches are compared letter by letter.

The first levels of the trie are the key by which its branches are dealt to tasks; a word is sent to every
branch that its budget reaches from the root. Near is mutual, so only words as long or one letter longer
are sought and each pair is found once. Branches of many words are cut into tiles: some of its leaves, and
some of the words that are sought there.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strongbox.llm.tables import HOT_KEYS, Rows, arrow_schema, partitions, rows_of, texts, written
from strongbox.llm.words import LOWER

#: Frequent letters are groups of their own, the others share some: that keeps the trie's first levels wide.
GROUPS, OWN_GROUP = 16, "etaoinsrhldc"
GROUP_OF = np.array([OWN_GROUP.find(chr(c)) if chr(c) in OWN_GROUP else len(OWN_GROUP) + c % (GROUPS - len(OWN_GROUP)) for c in range(256)])
#: A branch has so many words on average, or fewer: this decides how many levels its key has.
BRANCH = 100_000
#: Leaves and sought words of one tile; more where all words are very many.
LEAVES, SOUGHT = 20_000, 100_000
#: So many pairs of a word and a leaf are compared at once instead of going further down.
FEW = 8192


def word_counts(docs: DataFrame, shortest: int, every: int) -> DataFrame:
    """word and n: the runs of letters of all texts, some with a letter deleted, and how often they occur."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")
    schema = arrow_schema(word=pa.string(), n=pa.int64())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def take() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)
                held.clear()

        for doc_id, text in rows_of(batches, "doc_id", "text"):
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(runs.findall(text.encode().translate(LOWER).decode())).items():
                h = zlib.crc32(run.encode(), start)
                if h % every == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < shortest:
                        continue
                held[run] += n
            if len(held) >= 100_000:
                yield from take()
        yield from take()

    return texts(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters(words: Sequence[str]) -> np.ndarray:
    """The code points of all words, one behind another."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<i4")


def paths(words: Sequence[str]) -> np.ndarray:
    """How many letters of each group every word has."""
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(word * GROUPS + GROUP_OF[letters(words)], minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def moves(depth: int) -> np.ndarray:
    """What one edit may add to a word's length and to its counts in the first groups, on the way to words of
    its length or one letter longer."""
    steps = [(0,) * depth] + [tuple(int(k == i) for k in range(depth)) for i in range(depth)]
    longer = [(1, *plus) for plus in steps]
    same = {(0, *(p - m for p, m in zip(plus, minus))) for plus in steps for minus in steps}
    return np.array(longer + sorted(same), np.int32)


def branches(words: list[str], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The branch of each word, and for each that its budget reaches the word and the branch. A branch is
    the length and the counts in the first groups."""
    own = np.column_stack([np.array([len(w) for w in words], np.int32), paths(words)[:, :depth]])
    reach = own[:, None, :] + moves(depth)[None]
    word, move = np.nonzero((reach >= 0).all(2))
    return own, word, reach[word, move]


def search(leaves: np.ndarray, asked: np.ndarray, level: int, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Depth-first search from a node of the trie at ``level``: pairs of positions (leaf, asked) whose
    paths are within budget. ``leaves`` are the paths below the node in their order, ``asked`` those of the
    words that reached it, with the budget that each has left."""
    pending = [(level, 0, len(leaves), np.arange(len(asked)), surplus, deficit)]
    while pending:
        level, low, high, words, plus, minus = pending.pop()
        if level == GROUPS or (high - low) * len(words) <= FEW:
            step = max(1, FEW // len(words))
            for at in range(low, high, step):
                more = leaves[at : min(high, at + step), None, level:] - asked[None, words, level:]
                fits = (np.maximum(more, 0).sum(2) <= plus) & (np.maximum(-more, 0).sum(2) <= minus)
                leaf, word = np.nonzero(fits)
                yield leaf + at, words[word]
            continue
        column = leaves[low:high, level]
        starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
        for a, b in zip(starts, np.append(starts[1:], len(column)), strict=True):
            more = column[a] - asked[words, level]
            go = (more == 0) | ((more == 1) & (plus > 0)) | ((more == -1) & (minus > 0))
            if go.any():
                left = more[go]
                pending.append((level + 1, low + a, low + b, words[go], plus[go] - (left == 1), minus[go] - (left == -1)))


def one_edit(longer: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Which rows of letters differ by exactly one replaced letter or, where ``longer`` has one more, by
    one inserted letter."""
    width = word.shape[1]
    if longer.shape[1] == width:
        return (longer != word).sum(1) == 1
    same = np.logical_and.accumulate(longer[:, :width] == word, axis=1).sum(1)
    behind = np.logical_and.accumulate((longer[:, 1:] == word)[:, ::-1], axis=1).sum(1)
    return same + behind >= width


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (word, near, n) of words one edit apart, in both directions; n is that of ``near``.
    ``words`` has rows (word, n), each word once."""
    total, depth = words.count(), 2
    while depth < GROUPS and BRANCH * 4**depth < total:  # each level has about four branches of weight
        depth += 1

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                word, n = (part.column(part.schema.get_field_index(c)) for c in ("word", "n"))
                own, asked, reach = branches(word.to_pylist(), depth)
                for is_leaf, rows, keys in ((True, np.arange(len(own)), own), (False, asked, reach)):
                    keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * keys.shape[1]), len(keys), [None, pa.py_buffer(keys.astype("<i4").tobytes())])
                    leaf = pa.array(np.full(len(rows), is_leaf))
                    yield pa.RecordBatch.from_arrays([keys.cast(pa.binary()), leaf, word.take(pa.array(rows)), n.take(pa.array(rows))], ["branch", "leaf", "word", "n"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(word=pa.string(), near=pa.string(), n=pa.int64()), most=16384)

        def close(leaves: list[tuple[str, int]], asked: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
            length = len(leaves[0][0])
            found = paths([w for w, _ in leaves])
            order = np.lexsort(found.T[::-1])
            leaves, found = [leaves[i] for i in order], found[order]
            own = letters([w for w, _ in leaves]).reshape(-1, length)
            for size in (length, length - 1):
                part = [a for a in asked if len(a[0]) == size]
                if not part:
                    continue
                theirs, other = paths([w for w, _ in part]), letters([w for w, _ in part]).reshape(-1, size)
                more = found[0, :depth] - theirs[:, :depth]
                plus = 1 - np.maximum(more, 0).sum(1)
                minus = (1 if size == length else 0) - np.maximum(-more, 0).sum(1)
                step = max(1, (1 << 20) // length)
                for leaf, word in gathered(search(found, theirs, depth, plus, minus), step):
                    fits = one_edit(own[leaf], other[word])
                    for x, y in zip(leaf[fits].tolist(), word[fits].tolist(), strict=True):
                        (a, n), (b, m) = leaves[x], part[y]
                        if size < length or b < a:
                            out.add(a, b, m, size=2 * length)
                            out.add(b, a, n, size=2 * length)
                    if out.full():
                        yield from out.take()

        now, leaves, asked = None, [], []
        for *key, is_leaf, word, n in rows_of(batches, "branch", "leaves", "sought", "leaf", "word", "n"):
            if key != now:
                if leaves and asked:
                    yield from close(leaves, asked)
                now, leaves, asked = key, [], []
            if is_leaf:
                leaves.append((word, n))
            elif leaves:  # leaves come first
                asked.append((word, n))
                if len(asked) >= SOUGHT:
                    yield from close(leaves, asked)
                    asked = []
        if leaves and asked:
            yield from close(leaves, asked)
        yield from out.take()

    routed = written(words.mapInArrow(route, "branch binary, leaf boolean, word string, n long"), "routed")
    counted = routed.groupBy("branch").agg(F.count_if("leaf").alias("leaves"), F.count_if(~F.col("leaf")).alias("sought"))
    # As each limit grows with the words, only so many branches can be over one: fewer than 20 times HOT_KEYS.
    tiles = [F.ceil(F.col(c) / max(most, total // HOT_KEYS)).cast("int").alias(f"{c}_tiles") for c, most in (("leaves", LEAVES), ("sought", SOUGHT))]
    counted = counted.select("branch", *tiles).where("leaves_tiles > 1 or sought_tiles > 1")
    cut = routed.join(F.broadcast(counted), "branch", "left")

    def tile(of: str, own: Column) -> Column:
        n = F.coalesce(f"{of}_tiles", F.lit(1))
        return F.when(own, F.array(F.pmod(F.xxhash64("word"), n).cast("int"))).otherwise(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))

    dealt = cut.select("branch", F.explode(tile("leaves", F.col("leaf"))).alias("leaves"), "leaf", "word", "n", "sought_tiles")
    dealt = dealt.select("branch", "leaves", F.explode(tile("sought", ~F.col("leaf"))).alias("sought"), "leaf", "word", "n")
    key = ["branch", "leaves", "sought"]
    ordered = dealt.repartition(partitions(words.sparkSession), *key).sortWithinPartitions(*key, F.desc("leaf"))
    return ordered.mapInArrow(find, "word string, near string, n long")


def gathered(found: Iterator[tuple[np.ndarray, np.ndarray]], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in fewer, larger arrays of up to about ``most`` pairs."""
    held, n = [], 0
    for pair in found:
        for at in range(0, len(pair[0]), most):
            held.append(tuple(x[at : at + most] for x in pair))
            n += len(held[-1][0])
            if n >= most:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def last_forms(forms: DataFrame) -> DataFrame:
    """word and root: where following ``form`` from word to word ends. Every step at least goes to a more
    frequent word, so it ends; each round doubles the steps taken."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = written(roots.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if further.where("moved").isEmpty():
            return further.select("word", "root")
        roots = further.select("word", "root")


def spelling_variants(docs: DataFrame, shortest: int = 7, least: int = 2, times: int = 10, every: int = 31) -> DataFrame:
    """Words of all texts with the more frequent spelling that they are a variant of.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z only. A run whose
    crc32 of ``<doc_id>:<run>`` is divisible by ``every`` loses the letter at that number modulo its
    length. Kept are words of at least ``shortest`` code points that occur at least ``least`` times in all
    texts. Two are near if one inserted, deleted or replaced code point turns one into the other. Returns a
    row per word: word, n (its occurrences), n_near, form (its near word of largest n, among equals the
    smallest in code-point order, if its n is at least ``times`` as large, else null), form_n, and root
    (the last form that forms lead to, or the word itself).

    Null and empty texts have no words; a missing doc_id reads as the empty text. Every row counts, also
    where rows or ids repeat. Other columns are not used. Without words there are no rows.
    """
    words = written(word_counts(docs, shortest, every).where(F.col("n") >= least), "words")
    # The largest n, and among equals the smallest word.
    best = F.min(F.struct((-F.col("n")).alias("minus"), "near")).alias("best")
    found = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    near = words.join(found.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.minus")).alias("most")), "word", "left")
    is_form = F.col("most") >= times * F.col("n")
    near = written(
        near.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("most")).alias("form_n"),
        ),
        "forms",
    )
    roots = last_forms(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same in SQL: words that are one edit apart agree once a letter is deleted from one or both.
SPELLING_SQL = """
with recursive crc_table as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from range(256) r(i))),
runs as (
  select doc_id, run, count(*) as n from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]{7,}')) as run
    from documents) group by all),
coded as (
  select run, n, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as x from runs),
hashed as (
  select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as bigint))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) as h
  from coded, crc_table),
cut as (
  select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed),
words as (
  select word, cast(sum(n) as bigint) as n from cut where length(word) >= 7 group by word having sum(n) >= 2),
shorter as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, b.word as near, b.n from shorter a join shorter b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from shorter a join words b on a.rest = b.word
  union select b.word, a.word, a.n from shorter a join words b on a.rest = b.word),
best as (
  select word, count(*) as n_near, first(near order by n desc, near) as near, max(n) as most from near group by word),
formed as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when most >= 10 * w.n then near end as form, case when most >= 10 * w.n then most end as form_n
  from words w left join best b using (word)),
steps as (
  select word, word as at from formed
  union all select s.word, f.form from steps s join formed f on f.word = s.at where f.form is not null),
roots as (
  select s.word, s.at as root from steps s join formed f on f.word = s.at where f.form is null)
select word, form, root, n, n_near, form_n from formed join roots using (word)
"""

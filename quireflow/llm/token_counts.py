"""Token counts that survive edits: a segment tree over the pre-token runs of each document.

A document is cut into leaves of about `leaf_chars` characters. Cuts are only made in front of a
space that stands between two other characters: there every run of the tokenizer's pre-token pattern
ends whatever lies on either side, so leaves can be counted alone and their counts add up. A tree of
sums over the leaves (its size a power of two) gives totals and finds the leaf of an offset.

An edit (start, end, replacement; code points of the text before any edit) touches the leaves that
it overlaps. They are joined, edited, and cut again into the same number of slots; a neighbour
joins them while the cut towards it is no longer safe. Only these leaves are encoded again, and only
the sums above them change. Everything else keeps its counts.

Defined results: a null text is empty and has no tokens; edits beyond the end act at the end; edits
that overlap an earlier one are cut to what is left; a null list of edits or a null replacement is
empty; repeated rows give equal rows; a run without any safe cut is one leaf however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import small_batches

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-token pattern of this vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 512
EDITS = "array<struct<start:int,end:int,text:string>>"

_encodings: dict[int, object] = {}


def load_ranks(path: str = RANKS) -> bytes:
    """The vocabulary file as it is (about a megabyte), for a broadcast."""
    with open(path, "rb") as f:
        return f.read()


def encoding(ranks: bytes):
    """The tokenizer, made once in each Python worker."""
    import tiktoken

    key = hash(ranks)
    if key not in _encodings:
        merges = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return _encodings[key]


def safe(text: str, at: int) -> bool:
    """Whether text may be cut in front of position `at`."""
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


def cut(text: str, size: int) -> list[str]:
    """Pieces of at least `size` characters (but the last), cut at safe places."""
    out, last, at = [], 0, size
    while 0 < at < len(text):
        at = text.find(" ", at)
        if at < 0:
            break
        if safe(text, at):
            out.append(text[last:at])
            last = at
            at += size
        else:
            at += 1
    return [*out, text[last:]] if last < len(text) or not out else out


class Tree:
    """Leaves with their lengths and token counts, and sums of both over a complete binary tree."""

    def __init__(self, leaves: list[str], lengths: list[int], tokens: list[int]):
        self.leaves = leaves
        self.width = 1 << max(0, (len(leaves) - 1).bit_length())
        pad = [0] * (self.width - len(leaves))
        self.lengths = [0] * self.width + lengths + pad
        self.tokens = [0] * self.width + tokens + pad
        for i in range(self.width - 1, 0, -1):
            self._add(i)
        self.encoded_chars = 0

    @classmethod
    def of(cls, text: str, encoder, leaf_chars: int = LEAF_CHARS) -> Tree:
        leaves = cut(text, leaf_chars) if text else [""]
        return cls(leaves, [len(x) for x in leaves], [len(encoder.encode_ordinary(x)) for x in leaves])

    @classmethod
    def stored(cls, text: str, lengths: list[int], tokens: list[int]) -> Tree:
        """From the text and the lengths and counts that were kept: nothing is encoded."""
        leaves, at = [], 0
        for n in lengths:
            leaves.append(text[at : at + n])
            at += n
        return cls(leaves, list(lengths), list(tokens))

    def _add(self, i: int) -> None:
        self.lengths[i] = self.lengths[2 * i] + self.lengths[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.lengths[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, offset: int) -> tuple[int, int]:
        """The leaf that holds the character at `offset` (the last one that is not empty at the end), and its start."""
        offset = max(0, min(offset, self.n_chars - 1))
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if offset >= start + self.lengths[i]:
                start += self.lengths[i]
                i += 1
        return min(i - self.width, len(self.leaves) - 1), start

    def edit(self, start: int, end: int, text: str, encoder) -> None:
        """Replace characters start to end, encoding only what is touched."""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        first, begin = self.find(start)
        last, _ = self.find(max(start, end - 1))
        region = "".join(self.leaves[first : last + 1])
        region = region[: start - begin] + text + region[end - begin :]
        # While a cut at either end is not safe any more, what lies beyond it comes in.
        before, after = first - 1, last + 1
        while True:
            while before >= 0 and not self.leaves[before]:
                before -= 1
            while after < len(self.leaves) and not self.leaves[after]:
                after += 1
            if before >= 0 and not safe(self.leaves[before][-1] + region[:2] + "..", 1 if len(region) > 1 else 0):
                region = self.leaves[before] + region
                before -= 1
            elif after < len(self.leaves) and not (region and safe(region[-1] + self.leaves[after][:2], 1)):
                region += self.leaves[after]
                after += 1
            else:
                break
        slots = range(before + 1, after)
        parts = cut(region, max(1, -(-len(region) // len(slots))))
        for i, slot in enumerate(slots):
            part = parts[i] if i < len(parts) else ""
            self.leaves[slot] = part
            self.lengths[self.width + slot] = len(part)
            self.tokens[self.width + slot] = len(encoder.encode_ordinary(part))
            self.encoded_chars += len(part)
        above = {(self.width + slot) // 2 for slot in slots}
        while above and above != {0}:
            for i in above:
                self._add(i)
            above = {i // 2 for i in above if i > 1}

    def apply(self, edits: list[tuple[int, int, str]], encoder) -> None:
        """Edits by offsets of the text before any of them, from the last to the first."""
        clean, free = [], 0
        for start, end, text in sorted(edits, key=lambda e: (e[0], e[1])):
            start = max(start, free)
            clean.append((start, max(start, end), text))
            free = clean[-1][1]
        for start, end, text in reversed(clean):
            self.edit(start, end, text, encoder)


def build(docs: DataFrame, text: str = "text", leaf_chars: int = LEAF_CHARS, ranks: bytes | None = None) -> DataFrame:
    """`docs` with n_tokens, leaf_chars and leaf_tokens; columns of these names in `docs` are replaced."""
    docs = docs.drop(*({"n_tokens", "leaf_chars", "leaf_tokens"} - {text}))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks or load_ranks())
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(shared.value)
        for batch in batches:
            trees = [Tree.of(t.as_py() or "", encoder, leaf_chars) for t in batch.column(column)]
            cols = [pa.array([t.n_tokens for t in trees], pa.int64()), pa.array([t.lengths[t.width : t.width + len(t.leaves)] for t in trees], pa.list_(pa.int32())), pa.array([t.tokens[t.width : t.width + len(t.leaves)] for t in trees], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "n_tokens", "leaf_chars", "leaf_tokens"])

    schema = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in docs.schema), "n_tokens bigint, leaf_chars array<int>, leaf_tokens array<int>"])
    return docs.mapInArrow(run, schema)


def recount(built: DataFrame, edits: str = "edits", text: str = "text", ranks: bytes | None = None) -> DataFrame:
    """Rows of build() with a column of edits (EDITS) -> the same with the edited text, its leaves and
    n_tokens, and n_encoded_chars: how many characters had to be encoded again."""
    built = built.drop("n_encoded_chars")
    shared = built.sparkSession.sparkContext.broadcast(ranks or load_ranks())
    names = built.columns
    at = {n: names.index(n) for n in (text, edits, "n_tokens", "leaf_chars", "leaf_tokens")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(shared.value)
        for batch in batches:
            trees = []
            for t, changes, lengths, tokens in zip(*(batch.column(at[n]).to_pylist() for n in (text, edits, "leaf_chars", "leaf_tokens")), strict=True):
                tree = Tree.stored(t or "", lengths, tokens)
                tree.apply([(e["start"] or 0, e["end"] or 0, e["text"] or "") for e in changes or ()], encoder)
                trees.append(tree)
            cols = list(batch.columns)
            cols[at[text]] = pa.array([t.text() for t in trees], pa.string())
            cols[at["n_tokens"]] = pa.array([t.n_tokens for t in trees], pa.int64())
            cols[at["leaf_chars"]] = pa.array([t.lengths[t.width : t.width + len(t.leaves)] for t in trees], pa.list_(pa.int32()))
            cols[at["leaf_tokens"]] = pa.array([t.tokens[t.width : t.width + len(t.leaves)] for t in trees], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*cols, pa.array([t.encoded_chars for t in trees], pa.int64())], names=[*batch.schema.names, "n_encoded_chars"])

    schema = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in built.schema), "n_encoded_chars bigint"])
    return built.mapInArrow(run, schema)

"""BPE encoding and decoding by a tokenization automaton.

The merge list is compiled into a deterministic automaton over *tokens* whose
paths are exactly the correct tokenizations.  It begins as one state with a
loop for every base symbol; each merge ``(u, v) -> w`` then applies the merge
gadget in rank order:

* every ``u`` arc is redirected to a copy of its target that lacks the ``v`` arc;
* every state with a ``u`` arc also gets a ``w`` arc to where ``v`` led.

All arcs of one label lead to one state, so a state is named by the label that
enters it.  The copies are kept as deltas: the state of ``w`` is the state of
``v`` as it was at the rank of the merge, and a removal is one entry
``(label in, label out) -> rank``.  Whether state ``x`` has arc ``t`` is then
read from the removals along the chain of ``x`` and the chain of ``t``.

Words are encoded by a table of transitions over symbols, filled as words need it.  Any prefix of a word has one tokenization
(the automaton accepts one of every string), so what the rest of a word can still ask of the prefix is finite: its longest
end that begins some label, and the label that enters the state before each symbol of that end.  That is a state of the
table; a step leads to the one label that ends at the new symbol and has an arc from the state where it begins.  A word takes
one look-up for each symbol, and its labels are then read off backwards.  Decoding emits the label of
every arc.  Words repeat, so their ids are remembered, within a bound of bytes.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import bounded_batches, tidied

#: Bytes of remembered words that a worker holds (twice as many at most), and states of the table before it begins anew.
MEMO_BYTES, TABLE_STATES = 48 << 20, 1 << 17
#: Ends a word's spelling where the last symbol differs from others.
END = "\0"
#: Output characters after which a batch is handed on, so that long texts don't pile up.
BATCH_BYTES = 8 << 20


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character: printable Latin-1 bytes stand for themselves, and the
    others for the characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class MergeAutomaton:
    """The automaton of one vocabulary and merge list.

    ``vocab``: token string to id; ``merges``: pairs of token strings in rank
    order; ``suffix``: what the last symbol of a word carries ('' for none).
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix, self.ids = suffix, vocab
        self.left: dict[str, str] = {}
        self.right: dict[str, str] = {}
        self.born: dict[str, int] = {}
        self.removed: dict[tuple[str, str], int] = {}
        for rank, (u, v) in enumerate(merges):
            self._gadget(u, v, rank)
        self.spelled = {self.spelling(t): t for t in vocab if t not in self.dead}
        #: What may be the end of a prefix that a later label goes on from.
        self.begun = {x[:k] for x in self.spelled for k in range(len(x))}
        self._empty_table()

    # -- compilation
    @functools.cached_property
    def dead(self) -> set[str]:
        return set()

    def _gadget(self, u: str, v: str, rank: int) -> None:
        w = (u.removesuffix(self.suffix) if self.suffix else u) + v
        if w in self.born or u in self.dead or v in self.dead or not self.has_arc(u, v):
            if w not in self.born:
                self.dead.add(w)  # no state has this arc: an earlier merge takes one of its symbols
            return
        self.removed[u, v] = rank
        self.born[w], self.left[w], self.right[w] = rank, u, v

    def has_arc(self, state: str, label: str) -> bool:
        """Whether the state entered by ``state`` has an arc ``label``.

        A removal on an ancestor of the state counts if it was made before the copy;
        a removal of a stem of the label counts if it was made before the label's arc,
        and not after or by the label's own merge."""
        removed, born, x, x_born = self.removed, self.born, state, 1 << 60
        while x is not None:
            t, t_born = label, 1 << 60
            while t is not None:
                rank = removed.get((x, t))
                if rank is not None and rank < x_born and rank <= t_born:
                    return False
                t, t_born = self.left.get(t), born.get(t, -1)
            x, x_born = self.right.get(x), born.get(x, -1)
        return True

    def spelling(self, label: str) -> str:
        """A label's symbols as characters; a word's last symbol is two, the second of them ``END``."""
        return label.removesuffix(self.suffix) + END if self.suffix and label.endswith(self.suffix) else label

    # -- the table of transitions over symbols
    def _empty_table(self) -> None:
        self.step: list[dict[str, int]] = [{}]  # by state: symbol to state
        self.entered: list[tuple[str, int]] = [("", 0)]  # by state: the label that ends there, and its symbols
        # by state, what it stands for: that label, an end of the prefix, and then by twos a place in it and what enters there
        self.kept: list[tuple] = [("", "", 0, None)]
        self.known: dict[tuple, int] = {self.kept[0]: 0}
        self.looked_up: dict[tuple[str, str], bool] = {}

    def _arc(self, state: str, label: str) -> bool:
        found = self.looked_up.get((state, label))
        if found is None:
            if len(self.looked_up) >= TABLE_STATES:
                self.looked_up.clear()
            found = self.looked_up[state, label] = self.has_arc(state, label)
        return found

    def _transition(self, state: int, symbol: str) -> int:
        """Add the state after ``symbol``: its label is the longest that has an arc (there is one at most)."""
        kept = self.kept[state]
        tail, label, open_, spelled, begun = kept[1] + symbol, "", [], self.spelled, self.begun
        for j in range(2, len(kept), 2):
            k, u = kept[j], kept[j + 1]
            end = tail[k:]
            if not label and (t := spelled.get(end)) is not None and (u is None or self._arc(u, t)):
                label = t
            if end in begun:
                open_ += k, u
        if label:
            open_ += len(tail), label
        if open_ and (first := open_[0]):
            open_[::2] = [k - first for k in open_[::2]]
            tail = tail[first:]
        found = (label, tail if open_ else "", *open_)
        to = self.known.get(found)
        if to is None:
            to = self.known[found] = len(self.step)
            self.step.append({})
            self.entered.append((label, len(self.spelling(label))))
            self.kept.append(found)
        self.step[state][symbol] = to
        return to

    def arcs(self, word: str) -> list[str]:
        """The labels of the one path that spells the word (in the byte alphabet)."""
        if not word:
            return []
        if len(self.step) > TABLE_STATES:
            self._empty_table()
        spelled = word + END if self.suffix else word
        step, state, path = self.step, 0, []
        for c in spelled:
            to = step[state].get(c)
            state = to if to is not None else self._transition(state, c)
            path.append(state)
        out, at, entered = [], len(path), self.entered
        while at:
            label, n = entered[path[at - 1]]
            if not n:
                raise ValueError("a symbol of the word is not in the vocabulary")
            out.append(label)
            at -= n
        return out[::-1]


class Memo(dict):
    """A table that makes what it lacks.  Of at most twice ``size`` bytes, about: when full it becomes
    the old half, so what recurs stays.  Long keys aren't kept."""

    #: Bytes of an entry beside its characters and bytes.
    ENTRY = 200

    def __init__(self, make, size: int = MEMO_BYTES, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest, self.old, self.used = make, size, longest, {}, 0

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(key) <= self.longest:
            self.used += len(key) + len(value) + self.ENTRY
            if self.used > self.size:
                self.old, self.used = dict(self), 0
                self.clear()
            self[key] = value
        return value


class WordTokenizer:
    """What stands around the automaton in a tokenizer file with word ends: normaliser,
    word pattern, byte alphabet, special tokens, labels."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"] or spec["decoder"]:
            raise ValueError(f"{path}: not a tokenizer file of this kind")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.alphabet = byte_alphabet()
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Characters that every special token has: a text without one of them has no special token.
        self.marks = sorted(set.intersection(*map(set, self.special)), key=ord)[-2:] if self.special else []
        #: Characters that str.split takes for white space and the pattern doesn't.
        self.odd_space = regex.compile(r"[\x1c-\x1f]")
        self.space = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
        self.ids = {t: i.to_bytes(4, "little") for t, i in model["vocab"].items()}
        self.chunks = Memo(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a run without white space.  No match of the pattern crosses white space,
        and neither composition nor lower-casing does."""
        text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        ids, a, arcs = self.ids, self.alphabet, self.automaton.arcs
        found = b""
        for word in self.pattern.findall(text.lower()):  # one character at a time: no final sigma
            if not (word.isascii() and word.isprintable()):
                word = "".join([a[b] for b in word.encode("utf-8", "surrogatepass")])
            found += b"".join([ids[t] for t in arcs(word)])
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special_split and all(x in text for x in self.marks) and (parts := self.special_split.split(text))[1:]:
            return b"".join([self.special[p].to_bytes(4, "little") if k % 2 else self.encode(p) for k, p in enumerate(parts)])
        chunks = self.space.split(text) if self.odd_space.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))


class Labels:
    """The arcs' labels by id: all that decoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.labels = {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}

    def decode(self, ids: bytes | None) -> str:
        """The labels with a space between two, as a file without a decoder has it."""
        if not ids:
            return ""
        return " ".join(map(self.labels.__getitem__, memoryview(ids).cast("I").tolist()))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@functools.lru_cache(maxsize=2)
def labels(path: str) -> Labels:
    return Labels(path)


def _batches(rows: Iterator[pa.RecordBatch], make, size, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of the first column and the values that ``make`` gives for the second; handed on as soon as ``size`` of them is large."""
    for batch in rows:
        start, used, made = 0, 0, []
        keys, values = batch.column(0), batch.column(1)
        for k in range(batch.num_rows):
            made.append(make(values[k].as_py()))
            used += size(made[-1])
            if used >= BATCH_BYTES or k == batch.num_rows - 1:
                cols = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([keys.slice(start, k + 1 - start), *(pa.array(c, f.type) for c, f in zip(cols, schema, strict=True))], ["key", *schema.names])
                start, used, made = k + 1, 0, []


_BOTH = pa.schema([("ids", pa.binary()), ("decoded", pa.string())])


def _run(docs: DataFrame, key: str, value, kind: str, start, schema: str) -> DataFrame:
    """``start()`` gives a worker's batches from rows of key and value."""
    bounded_batches(docs.sparkSession)

    def run(rows):
        return tidied(start(rows))

    key_kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), value.cast(kind).alias("value")).mapInArrow(run, f"key {key_kind}, {schema}")


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", out: str = "ids") -> DataFrame:
    """One row per input row: ``key`` and ``out``, the ids as binary (little-endian uint32).

    Null and empty texts give empty ids; a null key is kept; repeated rows are kept as
    often as they come; columns other than the two named are not looked at, so they may
    have any name.  No shuffle; memory is bounded by one Arrow batch, the remembered words and the table."""

    def start(rows):
        t = tokenizer(path)
        return _batches(rows, lambda x: (t.encode(x),), lambda x: len(x[0]), pa.schema([_BOTH.field("ids")]))

    made = _run(docs, key, F.col(text), "string", start, "ids binary")
    return made.select(F.col("key").alias(key), F.col("ids").alias(out))


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """One row per input row: ``key``, the ids as they came, and ``out``, their text.

    Null ids decode to the empty text.  An id without a label is an error."""

    def start(rows):
        t = labels(path)
        return _batches(rows, lambda x: (x, t.decode(x)), lambda x: len(x[1]), _BOTH)

    made = _run(encoded, key, F.col(ids), "binary", start, "ids binary, decoded string")
    return made.select(F.col("key").alias(key), F.col("ids").alias(ids), F.col("decoded").alias(out))


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``decode`` of ``encode`` in one worker: ``key``, the ids, and the text that they decode to.  Rows as in ``encode``."""

    def start(rows):
        t, u = tokenizer(path), labels(path)

        def make(x):
            found = t.encode(x)
            return found, u.decode(found)

        return _batches(rows, make, lambda x: len(x[0]) + len(x[1]), _BOTH)

    made = _run(docs, key, F.col(text), "string", start, "ids binary, decoded string")
    return made.select(F.col("key").alias(key), F.col("ids").alias(ids), F.col("decoded").alias(out))


def digests(decoded: DataFrame, key: str = "doc_id", ids: str = "ids", text: str = "decoded") -> DataFrame:
    """What the query returns of encoded and decoded documents."""
    return decoded.select(
        F.col(key).alias("doc_id"),
        F.floor(F.octet_length(F.coalesce(F.col(ids), F.lit(b""))) / 4).cast("long").alias("n_tokens"),
        F.sha2(F.coalesce(F.col(ids), F.lit(b"")), 256).alias("ids_sha256"),
        F.sha2(F.encode(F.col(text), "UTF-8"), 256).alias("decoded_sha256"),
    )

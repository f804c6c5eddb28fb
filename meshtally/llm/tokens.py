"""Token counts by a finite-state transducer, composed over the chunks of a text.

**Compiled from the file.** Byte-pair merges make a sequence of tokens exactly when each two neighbours stay apart, that is
when no merge across their border would have come before those that made them. So the last token of
every prefix of a word follows from the last tokens of shorter prefixes, and reading one byte more is a transition: it
leads to a new last token and emits a number of tokens. Words read together are read in order, as
paths of a trie, so that what begins alike shares its transitions. Which characters are letters, digits or white space to
the tokenizer is compiled when a character is first met.

**Words.** Above the bytes the transducer reads words (white space and what follows it up to the next); a transition
carries the tokens emitted for the word and is kept. After every word it is in its start state, as no pattern of a
byte-level tokenizer reaches from the end of a word over the white space behind it.

**Chunks.** A chunk that begins in the middle of a word has a state map of three
parts, whatever came before: the bytes up to its first word's begin, which
belong to the word the chunk before left open, the count of the words inside, and
the word it leaves open itself. Maps of neighbouring chunks compose
associatively, so long texts are cut, mapped in parallel and composed pair by pair in rounds. Open words are held in parts and
read once, when they close, so the work is linear for texts without blanks too.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtally.llm.common import arrow_map
from meshtally.session import settle

CACHE = 400_000  # transitions over words, and over parts of words, that a worker keeps
CHUNK = 1 << 16  # characters
# Every character that any reading of "white space" takes in. Words end before one of
# these, unless it is one on which readings differ.
_WORD = re.compile("[\\s᠎]*[^\\s᠎]+|[\\s᠎]+")
_DOUBTFUL = re.compile("[\x1c-\x1f\x85᠎]")
_CUT = re.compile("(?<=[^\\s᠎])(?=[ \n])")
# The parts a byte-level tokenizer cuts words into, over classes of characters. Letters are L, or
# themselves where the pattern names them; N digits, S white space but for the blank, O all others but for '.
_PARTS = re.compile("'(?:[stmd]|re|ve|ll)| ?[Lstmdrevl]+| ?N+| ?[O']+|[ S]+(?![^ S])|[ S]+")

_machines: dict[str, "Transducer"] = {}


@dataclass(frozen=True)
class StateMap:
    """What a chunk does: ``head`` ends the word before, ``inside`` is counted, ``tail`` is left open; both in parts.

    A chunk without a certain word begin has only a head, and ``cut`` is False.
    """

    head: tuple[str, ...]
    inside: int = 0
    tail: tuple[str, ...] = ()
    cut: bool = False


def _byte_names() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, then from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    odd = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(odd)}}


class Merges:
    """The transducer over bytes. Tokens are numbered: bytes 0 to 255, then the merges in their order."""

    def __init__(self, merges: list[tuple[str, str]]) -> None:
        names = _byte_names()
        numbers = dict(names)
        self.left, self.right = [-1] * 256, [-1] * 256
        self.pair: dict[tuple[int, int], int] = {}
        texts = [bytes([b]) for b in range(256)]
        for a, b in merges:
            i, j = numbers[a], numbers[b]
            if a + b in numbers:
                raise ValueError(f"two merges make {a + b!r}")
            numbers[a + b] = self.pair[i, j] = len(texts)
            texts.append(texts[i] + texts[j])
            self.left.append(i)
            self.right.append(j)
        self.known: dict[int, bool] = {}
        # tokens as a trie from their last byte on: node * 256 + byte -> node, and the token a node ends at
        self.back: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for number, text in enumerate(texts):
            node = 0
            for byte in reversed(text):
                node = self.back.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = number
        # a token that its own bytes do not lead to is never emitted
        for number, text in enumerate(texts):
            if number > 255 and self.read([text])[0] != 1:
                node = 0
                for byte in reversed(text):
                    node = self.back[node << 8 | byte]
                self.ends[node] = -1
                self.known.clear()

    def apart(self, a: int, b: int) -> bool:
        """Whether no merge joins ``a`` and ``b``, or parts of them, across their border.

        Undone from the last merge on, the two show all pairs that ever met there. Of equal merges the left one comes first.
        """
        key = a << 32 | b
        if (found := self.known.get(key)) is not None:
            return found
        limit, result = len(self.left) + 1, True
        while True:
            joined = self.pair.get((a, b))
            if joined is not None and joined < limit:
                result = False
                break
            if a > b and a > 255:
                limit, a = a, self.right[a]
            elif b > 255:
                limit, b = b + 1, self.left[b]
            else:
                break
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[key] = result
        return result

    def read(self, parts: list[bytes]) -> list[int]:
        """Tokens of each of ``parts``, which come in order: the transitions of a common beginning are made once."""
        back, ends, apart = self.back, self.ends, self.apart
        last, count = [0], [0]  # by length of the path: last token, tokens emitted so far
        before, out = b"", []
        for part in parts:
            shared = 0
            for x, y in zip(part, before):
                if x != y:
                    break
                shared += 1
            del last[shared + 1:], count[shared + 1:]
            for i in range(shared, len(part)):
                node, j = 0, i
                while True:
                    # whole path taken back and no token found cannot be: every byte is one
                    node = back[node << 8 | part[j]]
                    token = ends[node]
                    if token >= 0 and (j == 0 or apart(last[j], token)):
                        break
                    j -= 1
                last.append(token)
                count.append(count[j] + 1)
            before = part
            out.append(count[-1])
        return out


class _Classes(dict):
    """Character numbers to their class, asked of the tokenizer's own splitter when first met."""

    def __init__(self, splitter) -> None:
        self.splitter = splitter

    def __missing__(self, number: int) -> str:
        c = chr(number)
        if c in " '":
            found = c
        elif len(self.splitter.pre_tokenize_str(f"a{c}a")) == 1:
            found = c if c in "stmdrevl" else "L"
        elif len(self.splitter.pre_tokenize_str(f"1{c}1")) == 1:
            found = "N"
        elif len(self.splitter.pre_tokenize_str(f"!{c}!")) == 1:
            found = "O"
        else:
            found = "S"
        self[number] = found
        return found


class Transducer:
    """Words to counts of emitted tokens, compiled from the file of a byte-level tokenizer."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splitter, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        if spec["normalizer"] or splitter.get("type") != "ByteLevel" or splitter["add_prefix_space"] or not splitter["use_regex"] \
                or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or any(
                    t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        self.merges = Merges([tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]])
        self.classes = _Classes(ByteLevel(add_prefix_space=False, use_regex=True))
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.emits: dict[str, int] = {}
        self.parts: dict[bytes, int] = {}

    @classmethod
    def at(cls, path: str) -> Transducer:
        if path not in _machines:
            _machines[path] = cls(path)
        return _machines[path]

    def _cut(self, word: str) -> tuple[int, list[bytes]]:
        """Special strings in a word, and its parts."""
        found, rest = 0, [word]
        if self.special and self.special.search(word):
            rest = self.special.split(word)
            found = len(rest) - 1
        parts = []
        for text in rest:
            for m in _PARTS.finditer(text.translate(self.classes)):
                parts.append(text[m.start():m.end()].encode())
        return found, parts

    def _learn(self, words: list[str]) -> None:
        """Transitions over new words."""
        cut = [self._cut(w) for w in words]
        if len(self.parts) > CACHE:
            self.parts = {}
        new = sorted({p for _, parts in cut for p in parts if p not in self.parts})
        self.parts.update(zip(new, self.merges.read(new)))
        for word, (special, parts) in zip(words, cut):
            self.emits[word] = special + sum(map(self.parts.__getitem__, parts))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text: the sum over the transitions its words take."""
        if len(self.emits) > CACHE:
            self.emits = {}
        emits = self.emits
        walks = [[t] if _DOUBTFUL.search(t) else _WORD.findall(t) for t in texts]
        new = list({w for words in walks for w in words if w not in emits})
        if new:
            self._learn(new)
        return [sum(map(emits.__getitem__, words)) for words in walks]

    def state_map(self, chunk: str) -> StateMap:
        """The map of one chunk; its first and last word stay open."""
        first = _CUT.search(chunk)
        if not first:
            return StateMap((chunk,))
        at = max(chunk.rfind(" "), chunk.rfind("\n"))
        while at > first.start() and not _CUT.match(chunk, at):
            at = max(chunk.rfind(" ", 0, at), chunk.rfind("\n", 0, at))
        at = max(at, first.start())
        return StateMap((chunk[:first.start()],), self.counts([chunk[first.start():at]])[0], (chunk[at:],), True)

    def _meet(self, a: tuple[str, ...], b: tuple[str, ...]) -> bool:
        """Whether a word begins just where the two open words meet."""
        x, y = next((p for p in reversed(a) if p), ""), next((p for p in b if p), "")
        return bool(_CUT.match(x[-1:] + y[:1], len(x[-1:])))

    def then(self, a: StateMap, b: StateMap) -> StateMap:
        """First ``a``, then ``b``; the word between them is closed if both have a begin."""
        if not a.cut and not b.cut:
            return StateMap(a.head, 0, b.head, True) if self._meet(a.head, b.head) else StateMap(a.head + b.head)
        if not a.cut:
            if self._meet(a.head, b.head):
                return StateMap(a.head, self.counts(["".join(b.head)])[0] + b.inside, b.tail, True)
            return StateMap(a.head + b.head, b.inside, b.tail, True)
        if not b.cut:
            if self._meet(a.tail, b.head):
                return StateMap(a.head, a.inside + self.counts(["".join(a.tail)])[0], b.head, True)
            return StateMap(a.head, a.inside, a.tail + b.head, True)
        return StateMap(a.head, a.inside + b.inside + self.counts(["".join(a.tail + b.head)])[0], b.tail, True)

    def reduce(self, maps: list[StateMap]) -> StateMap:
        """All maps composed, neighbours with neighbours, in rounds."""
        while len(maps) > 1:
            maps = [self.then(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def total(self, composed: StateMap) -> int:
        """Tokens of a whole text from its composed map: begin and end close the open words."""
        return composed.inside + sum(self.counts([x for x in ("".join(composed.head), "".join(composed.tail)) if x]))


def _chunks(batches, chunk: int):
    """(key, at, part) of each text (key, text), cut in one pass."""
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            for at in range(0, len(text), 64 * chunk):
                parts = [text[i:i + chunk] for i in range(at, min(len(text), at + 64 * chunk), chunk)]
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array([key] * len(parts)), "at": pa.array(range(at // chunk, at // chunk + len(parts)), pa.int32()),
                    "part": pa.array(parts)})


def _chunk_counts(long: DataFrame, tokenizer: str, chunk: int) -> DataFrame:
    """(key, n_tokens) for distinct long texts (key, text), their chunks mapped in parallel."""
    pieces = long.select("key", "text").mapInArrow(lambda b: _chunks(b, chunk), "key string, at int, part string")

    def of(batch: pa.RecordBatch) -> dict:
        machine = Transducer.at(tokenizer)
        maps = [machine.state_map(c) for c in batch.column(2).to_pylist()]
        return {"key": batch.column(0), "at": batch.column(1), "head": pa.array(["".join(m.head) for m in maps]),
                "inside": pa.array([m.inside for m in maps], pa.int64()), "tail": pa.array(["".join(m.tail) for m in maps]),
                "cut": pa.array([m.cut for m in maps])}

    mapped = arrow_map(pieces.repartition("key", "at"), of,
                       "key string, at int, head string, inside bigint, tail string, cut boolean")
    texts = mapped.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("at", "head", "inside", "tail", "cut"))).alias("maps"))

    def compose(batch: pa.RecordBatch) -> dict:
        machine = Transducer.at(tokenizer)
        totals = [machine.total(machine.reduce([StateMap((m["head"],), m["inside"], (m["tail"],), m["cut"]) for m in maps]))
                  for maps in batch.column(1).to_pylist()]
        return {"key": batch.column(0), "n_tokens": pa.array(totals, pa.int64())}

    return arrow_map(texts, compose, "key string, n_tokens bigint")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text; others are ignored).

    Counts are those of the ``tokenizers`` library for the file ``tokenizer`` (byte-level BPE)
    without added special tokens; special strings inside a text count as it counts them. NULL
    texts are empty: 0 bytes, 0 tokens. NULL ids and repeated rows stay; no rows give none. Texts of over ``chunk`` characters
    are cut into chunks of that many; equal ones are counted once.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.length("text") > chunk

    def of(batch: pa.RecordBatch) -> dict:
        n = Transducer.at(tokenizer).counts(batch.column(2).to_pylist())
        return {"doc_id": batch.column(0), "n_bytes": batch.column(1), "n_tokens": pa.array(n, pa.int64())}

    kind = dict(docs.dtypes)["doc_id"]
    n_bytes = F.octet_length("text").cast("bigint").alias("n_bytes")
    short = arrow_map(docs.where(~is_long).select("doc_id", n_bytes, "text"), of,
                      f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    long = docs.where(is_long).withColumn("key", F.sha2("text", 256))
    counted = settle(_chunk_counts(long.select("key", "text").dropDuplicates(["key"]), tokenizer, chunk))
    long = long.select("doc_id", n_bytes, "key").join(counted, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)

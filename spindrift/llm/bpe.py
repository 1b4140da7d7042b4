"""BPE encoding and decoding by a tokenization automaton.

``compile_automaton`` starts from the automaton that accepts every sequence of single-byte tokens and adds one
gadget for each merge, in order of rank: wherever the left token's arc leads to a state with the right token's
arc, a new arc with the merged label joins it, and the right arc leaves the state behind the left token. What
remains is a deterministic automaton over tokens that accepts the one right tokenization of each word and
no other (all arcs of a label lead to the same state). It is composed with the labels' spelling, so encoding walks tables
through the bytes of a word once; decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

START, FINAL = 0, 1
#: Entries of each of the two generations of a worker's caches, of pieces and of pre-tokens.
CACHE, WORDS = 1 << 17, 1 << 16
#: Suffixes that are pre-tokens of their own, and what counts as white space.
SUFFIXES = r"'s|'t|'re|'ve|'m|'ll|'d"
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEPARATORS = re.compile("[\x1c-\x1f]")


def default_vocabulary() -> str:
    """Path of the public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabularies of byte-level BPE."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def _category(name: str) -> str:
    """The code points whose general category begins so, as ranges of a character class."""
    out, start = [], None
    for code in range(0x110001):
        inside = code < 0x110000 and unicodedata.category(chr(code)).startswith(name)
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def pre_tokens():
    """Splits normalised text as the vocabulary file's pattern does: suffixes, runs of letters, single digits, other runs.

    Built from the standard library's character table; characters that it does not know are left to the file's library.
    """
    letters, numbers = _category("L"), _category("N")
    return re.compile(f"{SUFFIXES}|[{letters}]+|[{numbers}]|[^{SPACES}{letters}{numbers}]+").findall


@lru_cache(maxsize=1)
def _unknown():
    return re.compile(f"[{_category('Cn')}]").search


def has_unknown(text: str) -> bool:
    """Whether the text has a character that the standard library's table does not have."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _unknown()(text) is not None
    return False


class Automaton:
    """Which label may follow in each state, and the state behind each label.

    Merged labels form a tree: the left part of a merge is the parent. If a merge takes label b away from a state, it also takes
    the labels that later merges put under b, but not those that are there already. With the children of every label
    in order of their age, the youngest first, each removal is therefore one interval of the tree's depth-first order. A state
    is kept as the sorted edges of its intervals (``edges`` from ``first[state]`` on): a label has an arc there
    if its place lies outside all of them, which a bisection tells.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.suffix, self.ids = suffix, vocab
        self.labels = {i: s for s, i in vocab.items()}
        self._compile([(vocab[x], vocab[y], vocab[x + y]) for x, y in merges])
        self._spell()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "labels"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.labels = {i: s for s, i in self.ids.items()}

    def _spell(self) -> None:
        """Compose the labels with their spelling: a byte automaton whose nodes tell what labels end there, the longest first.

        ``next`` leads from node * 256 + byte to a node, ``fail`` to the node of its longest ending, which a byte without
        an entry goes on from. ``inside`` and ``at_end`` are a pair for labels within a word and at its end: the label of each
        node, and the nearest node with a label on the way along ``fail``, itself included.
        """
        byte = {c: b for b, c in enumerate(byte_characters())}
        self.next: dict[int, int] = {}
        self.size = array("i", [0]) * len(self.target)
        self.depth = array("i", [0])
        inside, at_end = array("i", [-1]), array("i", [-1])
        for text, label in self.ids.items():
            last = bool(self.suffix) and text.endswith(self.suffix) and len(text) > len(self.suffix)
            bare = text.removesuffix(self.suffix) if last else text
            if self.place[label] < 0 or any(c not in byte for c in bare):
                continue
            node = 0
            for c in bare:
                key = node << 8 | byte[c]
                above, node = node, self.next.get(key, 0)
                if not node:
                    node = self.next[key] = len(self.depth)
                    self.depth.append(self.depth[above] + 1)
                    inside.append(-1)
                    at_end.append(-1)
            self.size[label] = len(bare)
            if last or not self.suffix:
                at_end[node] = label
            if not last:
                inside[node] = label
        self.fail = array("i", [0]) * len(self.depth)
        near_inside, near_end = array("i", [0]) * len(self.depth), array("i", [0]) * len(self.depth)
        for key in sorted(self.next, key=lambda k: self.depth[k >> 8]):
            above, node = key >> 8, self.next[key]
            if above:
                self.fail[node] = self._step(self.fail[above], key & 255)
            near_inside[node] = node if inside[node] >= 0 else near_inside[self.fail[node]]
            near_end[node] = node if at_end[node] >= 0 else near_end[self.fail[node]]
        self.inside, self.at_end = (inside, near_inside), (at_end, near_end)

    def _step(self, node: int, byte: int) -> int:
        while (found := self.next.get(node << 8 | byte)) is None and node:
            node = self.fail[node]
        return found or 0

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        if any(c < max(x, y) for x, y, c in merges):
            raise ValueError("merged labels must have larger ids than their parts")
        if len({c for _, _, c in merges}) < len(merges):
            raise ValueError("two merges make the same label")
        size = max(self.ids.values(), default=-1) + 1
        target, left, made = array("i", [-1]) * size, array("i", [-1]) * size, array("i", [-1]) * size
        for symbol in byte_characters():
            for text, state in ((symbol, START), (symbol + self.suffix, FINAL)):
                if (i := self.ids.get(text)) is not None:
                    target[i] = state
        owners = {START: 1 + sum(t == START for t in target), FINAL: size}
        # of each state: what was taken from it (label, when), the state that it was copied from, and when
        taken: list[dict[int, int]] = [{}, {}]
        parent, born = [-1, -1], [0, 0]

        def lacks(state: int, label: int) -> bool:
            until = len(merges)
            while state >= 0:
                own, at, when = taken[state], label, len(merges)
                while at >= 0:
                    if (gone := own.get(at, until)) < until and gone <= when:
                        return True
                    at, when = left[at], made[at]
                until, state = min(until, born[state]), parent[state]
            return False

        for now, (a, b, c) in enumerate(merges):
            at = target[a]
            if at < 0 or target[b] < 0 or at == FINAL or lacks(at, b):
                continue  # the pair never meets: an earlier merge takes one of the two
            after = target[b]
            owners[after] = owners.get(after, 0) + 1
            if owners[at] > 1:
                owners[at] -= 1
                parent.append(at)
                born.append(now)
                taken.append({})
                at = target[a] = len(taken) - 1
                owners[at] = 1
            taken[at][b] = now
            target[c], left[c], made[c] = after, a, now
        self.states, self.target = len(taken), target
        self._order(taken, parent, born, left, made)

    def _order(self, taken: list[dict[int, int]], parent: list[int], born: list[int], left, made) -> None:
        """Place the labels in depth-first order and write down each state's edges."""
        size = len(self.target)
        children: list[list[int]] = [[] for _ in range(size)]
        for label in sorted((i for i in range(size) if left[i] >= 0), key=made.__getitem__, reverse=True):
            children[left[label]].append(label)
        self.place, end = array("i", [-1]) * size, array("i", [-1]) * size
        count = 0
        for root in range(size):
            if self.target[root] < 0 or left[root] >= 0:
                continue
            stack = [(root, iter(children[root]))]
            self.place[root] = count
            count += 1
            while stack:
                if (child := next(stack[-1][1], None)) is not None:
                    self.place[child] = count
                    count += 1
                    stack.append((child, iter(children[child])))
                else:
                    end[stack.pop()[0]] = count
        spans_of: list[list[tuple[int, tuple[int, int]]]] = []
        for own in taken:
            found = []
            for label, when in own.items():
                older = bisect_left(children[label], 1 - when, key=lambda x: -made[x])
                stop = self.place[children[label][older]] if older < len(children[label]) else end[label]
                found.append((when, (self.place[label], stop)))
            spans_of.append(found)
        self.edges, self.first = array("i"), array("i")
        for state in range(self.states):
            self.first.append(len(self.edges))
            spans, until, at = [(0, count)] if state == FINAL else [], size, state
            while at >= 0:
                spans += [span for when, span in spans_of[at] if when < until]
                until, at = min(until, born[at]), parent[at]
            reach = -1
            for lo, hi in sorted(spans):
                if lo > reach:
                    self.edges.extend((lo, hi))
                elif hi > reach:
                    self.edges[-1] = hi
                reach = max(reach, hi)
        self.first.append(len(self.edges))

    def has_arc(self, state: int, label: int) -> bool:
        lo = self.first[state]
        return self.place[label] >= 0 and not (bisect_right(self.edges, self.place[label], lo, self.first[state + 1]) - lo) & 1

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-token given in bytes: one walk over the bytes, then over the ends of labels that it met, from the word's end on.

        Of every beginning of the word the automaton accepts just one tokenization: ``state`` has where it leads, ``label`` its
        last label. Only beginnings that some label could follow are looked into, each once.
        """
        size, step, fail, depth = len(word), self.next.get, self.fail, self.depth
        place, first, edges, target = self.place, self.first, self.edges, self.target
        (labels, near), node = self.inside, 0
        nodes = [0]
        for byte in word:
            while (found := step(node << 8 | byte)) is None and node:
                node = fail[node]
            node = found or 0
            nodes.append(node)
        state, label = [-1] * (size + 1), [-1] * (size + 1)
        state[0] = START
        waiting = []
        end, own, own_near = size, *self.at_end
        at = own_near[node]
        while end:
            if not at:
                raise ValueError(f"no tokenization of {word!r}")
            begin = end - depth[at]
            here = state[begin]
            if here < 0:
                waiting.append((end, at))
                end, at, own, own_near = begin, near[nodes[begin]], labels, near
                continue
            x, lo = own[at], first[here]
            if (bisect_right(edges, place[x], lo, first[here + 1]) - lo) & 1:
                at = own_near[fail[at]]
                continue
            state[end], label[end] = target[x], x
            if not waiting:
                break
            end, at = waiting.pop()
            if end == size:
                own, own_near = self.at_end
        path = []
        while size:
            path.append(label[size])
            size -= self.size[label[size]]
        return path[::-1]


class Vocabulary:
    """A vocabulary file with its normalisation, and caches of pieces already encoded."""

    def __init__(self, spec: dict):
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # the library's own normaliser and splitter, without a vocabulary, for characters newer than our tables
        bare = {**spec, "added_tokens": [], "model": {**model, "vocab": {}, "merges": []}}
        self.splitter = json.dumps(bare)
        self.start()

    def __getstate__(self):
        return {"automaton": self.automaton, "special": self.special, "splitter": self.splitter}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.start()

    def start(self) -> None:
        self.pieces = Recent(self.ids_of, CACHE)
        self.words = Recent(self.word, WORDS)
        self.split = pre_tokens()
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.byte = {c: b for b, c in enumerate(byte_characters())}
        self.names = self.automaton.labels | {i: s for s, i in self.special.items()}
        self.library = None

    def word(self, word: str) -> bytes:
        """Ids of one pre-token, as little-endian 32-bit integers."""
        return _packed(self.automaton.encode(word.encode()))

    def ids_of(self, piece: str) -> bytes:
        """Ids of a normalised piece without white space."""
        if piece.isalpha():  # letters alone are one pre-token, with one common mark behind them two
            return self.words[piece]
        if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
            return self.words[piece[:-1]] + self.words[piece[-1]]
        return b"".join([self.words[word] for word in self.split(piece)])

    def ids_of_new(self, text: str) -> bytes:
        """Ids of a text with characters that the standard library does not know."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.splitter)
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return b"".join([_packed(self.automaton.encode(bytes(map(self.byte.__getitem__, word)))) for word, _ in words])

    def text_of(self, ids) -> str:
        """The labels of the ids, with one space between two."""
        return " ".join(map(self.names.__getitem__, ids))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        found: list[bytes] = []
        for part in segments(text, self.cut):
            if part in self.special:
                found.append(_packed([self.special[part]]))
            elif has_unknown(part):
                found.append(self.ids_of_new(part))
            else:
                found += map(self.pieces.__getitem__, pieces(part))
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids: the labels of the arcs that they stand for."""
        return self.text_of(struct.unpack(f"<{len(ids) // 4}I", ids))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Recent(dict):
    """A cache of ``make`` in two generations: what was not asked for since the last turn but one is forgotten."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def segments(text: str, cut) -> list[str]:
    """The text between strings of special tokens, and these."""
    return [x for x in cut.split(text) if x] if "<|" in text else [text]


def pieces(text: str) -> list[str]:
    """Normalised runs without white space; no pre-token crosses them."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    text = text.lower()
    return re.findall(f"[^{SPACES}]+", text) if _SEPARATORS.search(text) else text.split()


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        return Vocabulary(json.load(file))


_shared: dict[tuple[str, str], object] = {}


def _broadcast(spark: SparkSession, path: str | None):
    """One broadcast for each application and file: workers keep what they unpickled, and its caches, by broadcast."""
    key = spark.sparkContext.applicationId, path or default_vocabulary()
    if key not in _shared:
        _shared[key] = spark.sparkContext.broadcast(load_vocabulary(key[1]))
    return _shared[key]


def bpe_documents(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and what ``keep`` names of ids and decoded.

    Whole texts are encoded as the vocabulary file's library does without added special tokens, and decoded
    from the ids. The compiled automaton (its size is fixed by the vocabulary) is broadcast. Defined
    cases: a null or blank text has no tokens; special strings inside a text are their one token; repeated rows give
    repeated rows; an empty table gives no rows; other columns are ignored.
    """
    vocabulary = _broadcast(docs.sparkSession, path)
    extra = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            kept: dict[str, list] = {name: [] for name in keep}
            for text in batch.column("text"):
                ids = known.encode(text.as_py() or "")
                decoded = known.decode(ids)
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                if "ids" in kept:
                    kept["ids"].append(np.frombuffer(ids, "<i4"))
                if "decoded" in kept:
                    kept["decoded"].append(decoded)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            columns += [pa.array(kept[name], extra[name][1]) for name in keep]
            yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += "".join(f", {name} {extra[name][0]}" for name in keep)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(thin, run, schema)


def decode_ids(spark: SparkSession, encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (doc_id, ids) -> (doc_id, decoded): labels of the ids; null ids count as none."""
    vocabulary = _broadcast(spark, path)

    def run(batches):
        for batch in batches:
            texts = [vocabulary.value.text_of(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return map_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, decoded string")

"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens; the paths it allows are exactly the correct tokenizations, one for each
string. It is built by a gadget for each merge (u, v) -> w in the order of the merges:

* the state that u enters is copied without its arc for v, and all arcs for u now lead to the copy;
* every state that had arcs for u and then v gets an arc for w, to where v led.

What a state allows depends on the last token alone, and a copy differs from its original in a single
arc. So the gadgets' states are compiled into arrays of those differences: ``cut`` (a hash table) has
the step that took the arc for v from u's state, ``born`` the token whose state, as it was at the step
``born_at``, w enters, and ``begins`` the token whose arc, right after that step, decides where w's arc
starts. Whether a state has an arc follows from them in as many steps as merges nest.

Words are read a letter at a time by a second compiled table, the tokens' letters with their failure
arcs: its state names the tokens that end at a letter. A string's prefixes each have one correct
tokenization, so at each letter exactly one of those tokens is allowed after the token where it begins;
the automaton is deterministic and never goes back. All words of a batch advance together, a letter at
a time, by look-ups in these tables; arcs that were asked for stand in a table of fixed size. Decoding
emits the labels of the arcs.

Defined results: a null text counts as empty and has no tokens; texts and words of any length are
encoded whole, a window of the text at a time; rows, repeated or not, are independent of each other, so
ties do not arise; an empty table gives an empty result. The rows' other columns are kept in a struct,
so their names may clash with those made here.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, whole_row

#: The pre-tokenizer's pattern (white space as Unicode defines it), the end of a word.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"
CACHE = 100_000  # words that a worker remembers
ARCS = 18  # 2^ARCS arcs that a worker remembers
SLICE = 1 << 19  # bytes of text worked on at a time; longer texts are cut into such windows, at white space
ROWS = 1000  # of a batch that are worked on at a time
CELLS = 1 << 18  # letters of words that advance together
FEW = 24  # words that are not worth advancing together
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")  # white space for str.split() only
_LAST = 256  # added to the byte that ends a word
_MIX = 0x9E3779B97F4A7C15


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Table:
    """A hash table of numbers, by open addressing, read for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, absent: int):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask, self.absent = np.uint64(64 - bits), (1 << bits) - 1, absent
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, absent, np.int32)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[at[todo]] < 0
            self.keys[at[todo[free]]] = keys[todo[free]]  # of those with the same place the last stays
            placed = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[placed]]] = values[todo[placed]]
            todo = todo[~placed]
            at[todo] = at[todo] + 1 & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(_MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], self.absent)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            at[todo] = at[todo] + 1 & self.mask
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out

    def one(self, key: int) -> int:
        at = (key * _MIX & (1 << 64) - 1) >> int(self.shift)
        while (there := self.keys[at]) != key:
            if there < 0:
                return self.absent
            at = at + 1 & self.mask
        return int(self.values[at])


class Automaton:
    """vocab: token -> id; merges: pairs of tokens in order; end: suffix of a word's last letter."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>"):
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)  # letters of each token
        self._gadgets(*(np.array([vocab[x] for x in side], np.int64) for side in zip(*[(u, v, u + v) for u, v in merges], strict=True)))
        self._letters(vocab, end)
        self.known = np.full(1 << ARCS, -1, np.int64)

    def _gadgets(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        """One for each merge: its step takes u's arc for v and makes w's state and arc."""
        if len(np.unique(w)) < len(w):
            raise ValueError("two merges make the same token")
        self.never, steps = len(w), np.arange(len(w))
        self.cut = Table(u << 20 | v, steps, self.never)
        self.born, self.begins, self.born_at = (np.full(len(self.size), -1, np.int32) for _ in range(3))
        self.born[w], self.begins[w], self.born_at[w] = v, u, steps

    def _letters(self, vocab: dict[str, int], end: str) -> None:
        """The tokens' letters as a tree, level by level, with failure arcs. A word's last letter and its
        end mark are one letter."""
        byte = {c: b for b, c in enumerate(byte_letters())}
        spelled = []
        for token, i in vocab.items():
            ends = bool(end) and token.endswith(end)
            body = [byte.get(c, -1) for c in (token[: -len(end)] if ends else token)]
            if body and min(body) >= 0:
                body[-1] += _LAST * ends
                spelled.append((i, body))
                self.size[i] = len(body)
        tree: dict[int, int] = {}
        token, parent, letter, depth = [-1], [0], [0], [0]
        for i, body in spelled:
            node = 0
            for c in body:
                node_of = tree.setdefault(node << 9 | c, len(token))
                if node_of == len(token):
                    token.append(-1), parent.append(node), letter.append(c), depth.append(depth[node] + 1)
                node = node_of
            token[node] = i
        self.token, parents, letters, depths = (np.array(x, np.int32) for x in (token, parent, letter, depth))
        self.tree = Table(np.fromiter(tree, np.int64, len(tree)), np.fromiter(tree.values(), np.int64, len(tree)), -1)
        self.fail = np.zeros(len(token), np.int32)
        self.ends = np.zeros(len(token), np.int32)  # the longest suffix of the node's letters that is a token
        for level in range(1, int(depths.max()) + 1):
            nodes = np.flatnonzero(depths == level)
            if level > 1:
                self.fail[nodes] = self.read(self.fail[parents[nodes]], letters[nodes])
            self.ends[nodes] = np.where(self.token[nodes] >= 0, nodes, self.ends[self.fail[nodes]])

    def read(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The nodes after one more letter."""
        nodes, letters = nodes.astype(np.int64), letters.astype(np.int64)
        out = self.tree.get(nodes << 9 | letters)
        while len(todo := np.flatnonzero((out < 0) & (nodes > 0))):
            nodes[todo] = self.fail[nodes[todo]]
            out[todo] = self.tree.get(nodes[todo] << 9 | letters[todo])
        return np.maximum(out, 0)

    def arcs(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether the final state after each of the tokens ``states`` has an arc for one of ``tokens``."""
        state, token = states.astype(np.int64), tokens.astype(np.int64)
        now = np.full(len(state), self.never)  # the version of the state: before this step
        found, todo = np.ones(len(state), bool), np.arange(len(state))
        while len(todo):
            s, t, at = state[todo], token[todo], now[todo]
            gone = self.cut.get(s << 20 | t) < at
            found[todo[gone]] = False
            made, came = self.born_at[s], self.born_at[t]
            by_token = came > made
            token[todo] = np.where(by_token, self.begins[t], t)  # after this step's own cut
            state[todo] = np.where(by_token, s, self.born[s])
            now[todo] = np.where(by_token, np.minimum(at, came + 1), made)
            todo = todo[~gone & (by_token | (made >= 0))]
        return found

    def allows(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The same, from the table of arcs that were asked for."""
        keys = states.astype(np.int64) << 20 | tokens
        at = (keys.astype(np.uint64) * np.uint64(_MIX) >> np.uint64(64 - ARCS)).astype(np.int64)
        entry = self.known[at]
        new = np.flatnonzero(entry >> 1 != keys)
        if len(new):
            entry[new] = keys[new] << 1 | self.arcs(states[new], tokens[new])
            self.known[at[new]] = entry[new]
        return (entry & 1).astype(bool)

    def encode(self, word: bytes) -> list[int]:
        """The ids of one word."""
        n, node, last = len(word), 0, [-1] * (len(word) + 1)
        for i, c in enumerate(word, 1):
            c += _LAST * (i == n)
            while (after := self.tree.one(node << 9 | c)) < 0 and node:
                node = int(self.fail[node])
            node = max(after, 0)
            there = int(self.ends[node])
            while there:
                t = int(self.token[there])
                j = i - int(self.size[t])
                if not j or self.allows_one(last[j], t):
                    last[i] = t
                    break
                there = int(self.ends[self.fail[there]])
            else:
                raise ValueError("a letter is not in the vocabulary")
        ids, i = [], n
        while i:
            ids.append(last[i])
            i -= int(self.size[last[i]])
        return ids[::-1]

    def allows_one(self, state: int, token: int) -> bool:
        key = state << 20 | token
        entry = int(self.known[(key * _MIX & (1 << 64) - 1) >> 64 - ARCS])
        if entry >> 1 == key:
            return bool(entry & 1)
        return bool(self.allows(np.array([state]), np.array([token]))[0])

    def encode_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words (none of them empty), and where those of each begin and how many they are.
        Longest first, so that those that still have letters stand together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        starts, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        found: list[np.ndarray] = [np.zeros(0, np.int32)]
        alone = int(np.searchsorted(-lengths[order], -lengths[order[FEW - 1]])) if len(words) >= FEW else len(words)
        for k in order[:alone]:
            found.append(np.array(self.encode(words[k]), np.int32))
            counts[k] = len(found[-1])
        while alone < len(words):
            part = order[alone : alone + max(FEW, CELLS // int(lengths[order[alone]]))]
            alone += len(part)
            ids, counts[part] = self._together([words[k] for k in part], lengths[part])
            found.append(ids)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(found), starts, counts

    def _together(self, words: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """words: by falling length. The ids of all, and how many each has."""
        width, n = int(lengths[0]), len(words)
        letters = np.zeros((width, n), np.int32)
        inside = np.arange(width)[None, :] < lengths[:, None]
        letters.T[inside] = np.frombuffer(b"".join(words), np.uint8)
        letters[lengths - 1, np.arange(n)] += _LAST
        last = np.full((width + 1, n), -1, np.int32)
        node = np.zeros(n, np.int64)
        for i in range(1, width + 1):
            k = int(np.searchsorted(-lengths, -i, side="right"))  # words with a letter here
            node = self.read(node[:k], letters[i - 1, :k])
            row, there = np.arange(k), self.ends[node]
            while len(row):
                if not there.all():
                    raise ValueError("a letter is not in the vocabulary")
                token = self.token[there]
                start = i - self.size[token]
                ok = start == 0
                inner = np.flatnonzero(~ok)
                ok[inner] = self.allows(last[start[inner], row[inner]], token[inner])
                last[i, row[ok]] = token[ok]
                row, there = row[~ok], self.ends[self.fail[there[~ok]]]
        at, row, tokens, rows = lengths.copy(), np.arange(n), [], []
        while len(row):
            token = last[at[row], row]
            tokens.append(token)
            rows.append(row)
            at[row] -= self.size[token]
            row = row[at[row] > 0]
        of = np.concatenate(rows[::-1])
        return np.concatenate(tokens[::-1])[np.argsort(of, kind="stable")], np.bincount(of, minlength=n)


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of values, one after the other."""
    ends = np.cumsum(counts)
    return values[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Encodes and decodes texts as the tokenizer file at path says. ``known`` numbers what stands between
    white space; ``ids``, ``starts`` and ``counts`` have its ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.automaton = Automaton(vocab, merges, spec["model"]["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = {i: t for t, i in (vocab | self.special).items()}
        self.labels = pa.array([labels.get(i, "") for i in range(max(labels) + 1)], pa.string())
        self.numbers = pa.array([str(i) for i in range(len(self.labels))], pa.string())
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.white = regex.compile(f"[{WHITE}]")
        self.forget()

    def forget(self) -> None:
        """Empties the cache: a worker lives on after its task, beside those of other stages."""
        self.known: dict[str | int, int] = {i: n for n, i in enumerate(self.special.values())}
        self.ids = np.array([*self.special.values()], np.int32)
        self.starts, self.counts = np.arange(len(self.ids)), np.ones(len(self.ids), np.int64)

    def _chunks(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # each letter on its own: no final sigma
        if any(c in text for c in _ODD_SPACE):
            return [c for c in regex.split(f"[{WHITE}]+", text) if c]
        return text.split()

    def _parts(self, text: str) -> list[str | int]:
        """What stands between white space; special tokens as their ids."""
        if self.split_special and any(s in text for s in self.special):
            found: list[str | int] = []
            for part in self.split_special.split(text):
                found += [self.special[part]] if part in self.special else self._chunks(part)
            return found
        return self._chunks(text)

    def _learn(self, chunks: set[str]) -> None:
        plain, mixed = [c for c in chunks if c.isalpha()], [c for c in chunks if not c.isalpha()]
        pieces = [self.pieces.findall(c) for c in mixed]
        words = {w: n for n, w in enumerate(dict.fromkeys(chain(plain, *pieces)))}
        if not words:
            return
        ids, starts, counts = self.automaton.encode_many([w.encode() for w in words])
        of = np.fromiter((words[p] for ps in pieces for p in ps), np.int64)
        each = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.cumsum(each) - each
        mixed_counts = np.add.reduceat(counts[of], first) if len(mixed) else np.zeros(0, np.int64)
        mixed_ids = gather(ids, starts[of], counts[of])
        for n, c in enumerate(chain(plain, mixed), len(self.counts)):
            self.known[c] = n
        at = len(self.ids)
        self.ids = np.concatenate([self.ids, ids, mixed_ids])
        self.starts = np.concatenate([self.starts, at + starts[: len(plain)], at + len(ids) + np.cumsum(mixed_counts) - mixed_counts])
        self.counts = np.concatenate([self.counts, counts[: len(plain)], mixed_counts])

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._parts(t) for t in texts]
        if len(self.known) > CACHE:
            self.forget()
        self._learn(set(chain.from_iterable(parts)).difference(self.known))
        chunks = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64)
        counts = self.counts[chunks]
        before = np.concatenate([[0], np.cumsum(counts)])
        return gather(self.ids, self.starts[chunks], counts), before[np.cumsum([0, *map(len, parts)])]

    def _windows(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE:
            space = self.white.search(text, at + SLICE)
            if not space:
                break
            yield text[at : space.start()]
            at = space.start()
        yield text[at:]

    def encode_texts(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of some of the texts after the other, and where each text's begin and the last's end."""
        waiting: list[str] = []
        size = 0
        for text in texts:
            waiting.append(text or "")
            size += len(waiting[-1])
            if size > SLICE:
                *short, long = waiting
                if short:
                    yield self._slice(short)
                ids = [self._slice([w])[0] for w in self._windows(long)]
                yield np.concatenate(ids), np.array([0, sum(map(len, ids))])
                waiting, size = [], 0
        if waiting:
            yield self._slice(waiting)

    def joined(self, of: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The numbers or labels of each text's ids, joined by one space."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), of.take(pa.array(ids))), " ")

    def encode_text(self, text: str | None) -> tuple[str, str]:
        """(decimal ids joined by one space, decoded text)."""
        ids, ends = next(self.encode_texts([text]))
        return self.joined(self.numbers, ids, ends)[0].as_py(), self.joined(self.labels, ids, ends)[0].as_py()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One automaton for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", with_ids: bool = False, with_decoded: bool = False) -> DataFrame:
    """Adds to the rows of docs (as _row, without the text if ids are asked for elsewhere) n_tokens,
    ids_sha256 and decoded_sha256, and on request ids (array of int) and decoded (string)."""
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    rows = docs.select(whole_row(rest), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            at = 0
            for ids, ends in enc.encode_texts(x.as_py() for x in batch.column(1)):
                numbers, labels = enc.joined(enc.numbers, ids, ends), enc.joined(enc.labels, ids, ends)
                digest = lambda joined: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in joined], pa.string())
                columns = {"_row": batch.column(0).slice(at, len(numbers)), "n_tokens": pa.array(np.diff(ends), pa.int64()), "ids_sha256": digest(numbers), "decoded_sha256": digest(labels)}
                columns |= {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))} if with_ids else {}
                columns |= {"decoded": labels} if with_decoded else {}
                yield pa.RecordBatch.from_pydict(columns)
                at += len(numbers)
        enc.forget()

    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema + ", ids array<int>" * with_ids + ", decoded string" * with_decoded)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """op10: counts and digests of the encoding of every document."""
    found = encode_documents(documents(spark, sf_dir, "doc_id", "text"), path or vocabulary())
    return found.select("_row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

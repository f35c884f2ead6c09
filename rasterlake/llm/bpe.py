"""Byte-pair encoding and decoding with a tokenization automaton.

The merges are compiled, one merge gadget after another, into a deterministic automaton whose arcs carry
tokens. It has one state per token ("that token was read last"). For a merge ``a b -> ab`` the gadget takes
the arc ``b`` out of the state behind ``a``, gives every state that has an arc ``a`` an arc ``ab`` as well,
and makes the state behind ``ab`` a copy of the one behind ``b``. A merge whose arc is not there when its turn comes
can never happen and adds nothing. The paths that remain spell exactly the token sequences that the merges give, so
each string has one path.

States are copy-on-write: a gadget stores what it changed (the arc it took out, the state that was copied and
the time of the copy), so the automaton takes a few arrays of vocabulary size instead of the square of it.

For encoding, the labels are spelt out in bytes and the automaton is made deterministic again: a state of the byte
table is the set of tokens that may be under way (each with the token read before it) and the token that
ends here on the one path. Its transitions are compiled as they are first needed and looked up ever after. A word is
read once from left to right; the tokens of its path are then read off from its end. Nothing is tried twice.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from rasterlake.llm.common import begin_task, holds, table

#: The splitting pattern of byte-level BPE vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 62


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _supported(data: dict) -> None:
    """Raise for settings of a tokenizer file that this module does not follow."""
    model, before = data["model"], data.get("pre_tokenizer") or {}
    wrong = [c for c in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(c)]
    wrong += ["normalizer"] if data.get("normalizer") else []
    wrong += ["pre_tokenizer"] if before and (before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True)) else []
    wrong += [f"added token {t['content']!r}" for t in data.get("added_tokens", []) if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if model.get("type", "BPE") != "BPE":
        wrong.append("model")
    if wrong:
        raise ValueError("not supported in a tokenizer file: " + ", ".join(wrong))


class TokenAutomaton:
    """Deterministic automaton over tokens for a byte-level vocabulary with ranked merges.

    ``spec`` is the text of a tokenizer file (JSON with ``model.vocab``, ``model.merges`` and ``added_tokens``); parts of a
    token must come from earlier merges, as trained files have them. ``word_cache`` words of at most ``word_chars`` characters keep their ids;
    ``states`` of the byte table, and ``arc_cache`` arcs that were worked out, are held at a time, then emptied.
    """

    def __init__(self, spec: str, word_cache: int = 400_000, word_chars: int = 48, states: int = 200_000, arc_cache: int = 500_000):
        data = json.loads(spec)
        _supported(data)
        vocab = data["model"]["vocab"]
        of_symbol = {c: b for b, c in enumerate(byte_symbols())}
        size = max([*vocab.values(), *(t["id"] for t in data["added_tokens"])]) + 1
        self.labels: list[bytes] = [b""] * size
        for symbol, i in vocab.items():
            self.labels[i] = bytes(of_symbol[c] for c in symbol) if all(c in of_symbol for c in symbol) else symbol.encode()
        self.special = {}
        for t in data["added_tokens"]:
            self.labels[t["id"]] = t["content"].encode()
            self.special[t["content"]] = t["id"]
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        self.taken: dict[int, int] = {}
        self.reachable = {i for c, i in vocab.items() if len(self.labels[i]) == 1}
        for time, merge in enumerate(data["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self._gadget(vocab[a], vocab[b], vocab[a + b], time)
        self.arcs: dict[int, bool] = {}
        self.arc_cache = arc_cache
        # A tree of the labels: a node for each prefix, its bytes leading to others.
        self.kids: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.inner: list[bool] = [False]
        for i in self.reachable:
            node = 0
            for byte in self.labels[i]:
                below = self.kids.get(node << 8 | byte)
                if below is None:
                    below = self.kids[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = below
            self.token_at[node] = i
        self.most_states = states
        self._empty_table()
        self.words: dict[str, bytes] = {}
        self.word_cache, self.word_chars = word_cache, word_chars
        self.split = regex.compile(SPLIT)
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _gadget(self, a: int, b: int, ab: int, time: int) -> None:
        """Add one merge: take arc ``b`` from the state behind ``a`` at ``time``; the arc ``ab`` runs beside ``a`` and its state copies that of ``b``."""
        if a not in self.reachable or b not in self.reachable or not self._arc_at(a, b, time):
            return
        self.taken[(a << 24) | b] = time
        self.left[ab], self.right[ab], self.born[ab] = a, b, time
        self.reachable.add(ab)

    def _empty_table(self) -> None:
        """The byte table with its start state alone: nothing read, any token may begin."""
        self.table: dict[int, int] = {}
        self.under_way: list[tuple[tuple[int, int], ...]] = [((-1, 0),)]
        self.last: list[int] = [-1]
        self.state_of: dict[tuple, int] = {}

    def _start_again(self, state: int) -> int:
        """Empty the byte table but for ``state``, and give its new number."""
        known, done = self.under_way[state], self.last[state]
        self._empty_table()
        if state == 0:
            return 0
        self.state_of[known] = 1
        self.under_way.append(known)
        self.last.append(done)
        return 1

    def _compile(self, state: int, byte: int) -> int:
        """The transition of the byte table from ``state`` by ``byte``."""
        out, done = [], -1
        for before, node in self.under_way[state]:
            node = self.kids.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token_at[node]
            if token >= 0 and (before < 0 or self.has_arc(before, token)):
                done = token
            if self.inner[node]:
                out.append((before, node))
        if done < 0:
            raise ValueError(f"the vocabulary has no token for the byte {byte}")
        out.append((done, 0))
        known = tuple(out)
        after = self.state_of.get(known)
        if after is None:
            after = self.state_of[known] = len(self.last)
            self.under_way.append(known)
            self.last.append(done)
        self.table[state << 8 | byte] = after
        return after

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state behind ``state`` has an arc ``token`` once all gadgets are in; kept."""
        key = (state << 24) | token
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= self.arc_cache:
                self.arcs.clear()
            known = self.arcs[key] = self._arc_at(state, token, NEVER)
        return known

    def _arc_at(self, state: int, token: int, time: int) -> bool:
        """Whether the arc is there before the gadget of ``time`` is added."""
        while True:
            if self.taken.get((state << 24) | token, NEVER) < time:
                return False
            born_s, born_t = self.born[state], self.born[token]
            if born_s < 0 and born_t < 0:
                return True
            if born_t > born_s:  # the arc came beside the arc of its left part, after that gadget took its own arc out
                time = born_t + 1
                token = self.left[token]
            else:  # the state was copied from that of its right part, just before that gadget took its arc out
                time = born_s
                if born_s == born_t:  # one token twice: its own arc came beside that of its left part
                    token = self.left[token]
                state = self.right[state]

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the one path through the automaton that spells ``word``.

        The byte table is emptied when it is full, in the middle of a word too: a state is what is under way there, which goes on in the new table.
        """
        state, ends = 0, array("i")
        table, last = self.table, self.last
        for byte in word:
            after = table.get(state << 8 | byte)
            if after is None:
                if len(last) > self.most_states:
                    state = self._start_again(state)
                    table, last = self.table, self.last
                after = self._compile(state, byte)
            state = after
            ends.append(last[state])
        path, at = [], len(word)
        while at:
            path.append(ends[at - 1])
            at -= len(self.labels[path[-1]])
        return path[::-1]

    def _word_ids(self, piece: str) -> bytes:
        ids = b"".join(i.to_bytes(4, "little") for i in self.encode_word(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= self.word_chars:
            if len(self.words) >= self.word_cache:
                self.words.clear()
            self.words[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a null text counts as empty."""
        if not text:
            return b""
        out: list[bytes] = []
        words, make = self.words, self._word_ids
        parts = self.special_split.split(text) if self.special_split else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out.extend([words.get(p) or make(p) for p in self.split.findall(part)])
        return b"".join(out)

    def decode_bytes(self, ids: bytes) -> bytes:
        """Emit the labels of the arcs."""
        labels = self.labels
        return b"".join([labels[i] for i in memoryview(ids).cast("I").tolist()]) if ids else b""

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_COMPILED: dict[str, TokenAutomaton] = {}
holds("bpe", _COMPILED.clear)


def automaton(spec: str) -> TokenAutomaton:
    """One compiled automaton per worker process and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = TokenAutomaton(spec)
    return _COMPILED[key]


def encode_documents(df: DataFrame, tokenizer_path: str, text: str = "text", keep: list[str] | None = None, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encode and decode every text, adding the columns named in ``outputs``.

    ``n_tokens`` (long) always comes; ``outputs`` picks from ``ids`` (binary, little-endian unsigned 32-bit),
    ``decoded`` (string), ``ids_sha256`` and ``decoded_sha256`` (string). Columns of ``keep`` (default: all
    others) pass through; those whose names clash with an output are dropped. Null or empty text: no tokens and
    empty decoded text. Repeated rows each give a row; an empty table gives an empty one. One narrow pass: no
    shuffle, and a worker holds one Arrow batch, the automaton and bounded caches.
    """
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # a vocabulary file: its size does not depend on the data
        spec = spark.sparkContext.broadcast(f.read())
    new = [("n_tokens", "long", pa.int64()), *((c, "binary" if c == "ids" else "string", pa.binary() if c == "ids" else pa.string()) for c in outputs)]
    names = {c for c, _, _ in new}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = df.select(*kept, df[text].alias("__text"))
    fields = [f for f in source.schema.fields if f.name != "__text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{c}` {t}" for c, t, _ in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("bpe")
        auto = automaton(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols: dict[str, list] = {c: [] for c in names}
                for value in part.column(part.num_columns - 1):
                    ids = auto.encode(value.as_py())
                    cols["n_tokens"].append(len(ids) // 4)
                    if "ids" in names:
                        cols["ids"].append(ids)
                    if "ids_sha256" in names:
                        cols["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    if "decoded" in names or "decoded_sha256" in names:
                        raw = auto.decode_bytes(ids)
                        if "decoded" in names:
                            cols["decoded"].append(raw.decode("utf-8", "replace"))
                        if "decoded_sha256" in names:
                            cols["decoded_sha256"].append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
                arrays = [part.column(i) for i in range(part.num_columns - 1)] + [pa.array(cols[c], t) for c, _, t in new]
                yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names[:-1], *(c for c, _, _ in new)])

    return source.mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    docs = table(spark, sf_dir, "documents")
    return encode_documents(docs, default_tokenizer(), keep=["doc_id"], outputs=("ids_sha256", "decoded_sha256"))

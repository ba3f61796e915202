"""Token counts by a compiled finite-state transducer.

A byte-level BPE vocabulary (JSON file of the ``tokenizers`` library) is
compiled, state by state as texts need it, into one deterministic transducer
over characters. Every transition carries a number: by how much the count of
tokens of the text read so far changes. Summing them from the start state gives
the count that the library gives for the whole text.

How a state looks. The pre-tokenizer cuts a text into pieces; a state names the
kind of the open piece (letters, digits, other, white space, or an apostrophe
that may start a contraction) and the merge history of that piece: for each
place where a token can still be open, the trie node that has been reached
since, the last token before that place, and the count there relative to now.
A token closes the history at a place if it and the token before it do not
merge differently together. Two texts with equal histories have equal futures,
so states are shared. New words still bring new states; a worker keeps at most
``MAX_STATES`` of them and ``MAX_MAPS`` chunk maps, and starts anew beyond that.

A text is cut into chunks of a fixed length, and a chunk's state map takes any
state to a state and a count. At some places a piece ends whatever the state is:
between a character that is not white space and a space, or between a letter and
a punctuation mark. So a map keeps what precedes the chunk's first certain
boundary, and for the rest has one count and one state. The words between certain
boundaries are the same again and again; a worker remembers their counts. Maps
do not depend on each other and compose associatively; a prefix scan with about
two compositions a chunk composes them, in rounds whose compositions are again
independent. A chunk without a certain boundary is joined with the next one, so a
text without any is one run. All of a text's chunks are in the task that has its row.

Defined results: a null or empty text has 0 tokens and 0 bytes; a null id stays
null; repeated rows are counted each; other columns are ignored. An added
special token inside a text is one token, as the library has it by default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, spread, table
from tidemark.runtime import ship

#: Characters of a chunk; states and chunk maps that a worker keeps before it starts anew.
CHUNK, MAX_STATES, MAX_MAPS = 4_096, 250_000, 1_000_000
LETTER, DIGIT, OTHER, SPACE = "L", "N", "O", "S"
#: Contractions of the pre-tokenizer, by their second character.
SHORT, LONG = "stmd", {"r": "e", "v": "e", "l": "l"}
#: A certain boundary. Python counts a few more characters as white space than the pre-tokenizer does, which is safe here.
_SYNC = re.compile(r"(?<=\S) ")
#: Any certain boundary. Letters and marks that all Unicode versions have as such; an apostrophe may belong to a contraction and is none.
_FIRST = re.compile("(?<=\\S) |(?<=[A-Za-z\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])(?=[,.!?;:\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, as character to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class State(dict):
    """Transitions out of a state: character to (state, change of the count). Missing ones are compiled."""

    __slots__ = ("compiler", "key")

    def __missing__(self, ch: str):
        to, delta = self.compiler.step(self.key, ch)
        self[ch] = out = (self.compiler.state(to), delta)
        return out


class ChunkMaps(dict):
    """Counts of chunks that follow a certain boundary, by their text without the space that starts them."""

    __slots__ = ("compiler",)

    def __missing__(self, chunk: str) -> int:
        if len(self) >= MAX_MAPS:
            self.clear()
        n = self.compiler.run(self.compiler.start, " " + chunk)[1]
        if len(chunk) <= 64:
            self[chunk] = n
        return n


class Transducer:
    def __init__(self, path: str, max_states: int = MAX_STATES):
        from tokenizers import Tokenizer

        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        spec = json.load(open(path, encoding="utf-8"))
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.text_of = {i: raw(s) for s, i in spec["model"]["vocab"].items()}
        ids = {b: i for i, b in self.text_of.items()}
        self.byte_id = [ids.get(bytes([b]), -1) for b in range(256)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            self.rank.setdefault((ids[a], ids[b]), (n, ids[a + b]))
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.special_re = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        # The trie of all tokens: node * 256 + byte to node, and the token that ends at a node.
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        for i, text in self.text_of.items():
            node = 0
            for b in text:
                at = node << 8 | b
                if at not in self.child:
                    self.child[at] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.child[at]
            self.token_at[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.kinds: dict[str, str] = {}
        self.max_states = max_states
        self.maps = ChunkMaps()
        self.maps.compiler = self
        self.states: dict[tuple, State] = {}
        self.start = self.state(("Q",))

    def state(self, key: tuple) -> State:
        found = self.states.get(key)
        if found is None:
            if len(self.states) >= self.max_states:
                self.states.clear()
                self.start.clear()
                self.states[("Q",)] = self.start
            found = self.states[key] = State()
            found.compiler, found.key = self, key
        return found

    def kind(self, ch: str) -> str:
        """Asked of the library's own pre-tokenizer, so that both have one Unicode version."""
        found = self.kinds.get(ch)
        if found is None:
            one = lambda before: len(self.splitter.pre_tokenize_str(before + ch)) == 1
            found = self.kinds[ch] = LETTER if one("a") else DIGIT if one("1") else OTHER if one("!") else SPACE
        return found

    def merged(self, ids: list[int]) -> list[int]:
        while len(ids) > 1:
            best = min((self.rank.get(p, (1 << 60, 0)) + (i,) for i, p in enumerate(zip(ids, ids[1:]))), default=None)
            if best[0] == 1 << 60:
                break
            a, b = ids[best[2]], ids[best[2] + 1]
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def fit(self, before: int, token: int) -> bool:
        """Do these two tokens, side by side, stay as they are? before: -1 at the start of a piece."""
        found = self.fits.get((before, token))
        if found is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            text = (self.text_of[before] if before >= 0 else b"") + self.text_of[token]
            found = self.fits[before, token] = self.merged([self.byte_id[b] for b in text]) == ([before, token] if before >= 0 else [token])
        return found

    def push(self, history: tuple, text: bytes) -> tuple[tuple, int]:
        """The history after more bytes of the same piece, and the change of the piece's count."""
        total = 0
        for b in text:
            grown, last, delta = [], -1, 0
            for node, before, rel in history:
                to = self.child.get(node << 8 | b)
                if to is None:
                    continue
                grown.append((to, before, rel))
                token = self.token_at[to]
                if last < 0 <= token and self.fit(before, token):
                    last, delta = token, rel + 1
            history = (*((n, t, r - delta) for n, t, r in grown), (0, last, 0))
            total += delta
        return history, total

    EMPTY = ((0, -1, 0),)

    def fresh(self, ch: str, space: bool = False) -> tuple[tuple, int]:
        """A new piece that starts with ``ch``, or with a space and ``ch``: its state and count."""
        kind = self.kind(ch)
        history, n = self.push(self.EMPTY, (" " + ch if space else ch).encode())
        if kind == SPACE:
            return (SPACE, history, -n, True, ch), n
        return ("A" if ch == "'" and not space else kind, history), n

    def step(self, key: tuple, ch: str) -> tuple[tuple, int]:
        mode, kind, count = key[0], self.kind(ch), lambda s: self.push(self.EMPTY, s.encode())[1]
        if mode == "Q":
            return self.fresh(ch)
        if mode in LONG:  # an apostrophe and r, v or l
            if ch == LONG[mode]:
                return ("Q",), count("'" + mode + ch) - count("'") - count(mode)
            mode = LETTER
        if mode == "A":
            if ch in SHORT:
                return ("Q",), count("'" + ch) - count("'")
            if ch in LONG:
                history, n = self.push(self.EMPTY, ch.encode())
                return (ch, history), n
            mode = OTHER
        if mode == SPACE:
            _, history, before, single, last = key
            if kind == SPACE:
                history, n = self.push(history, ch.encode())
                return (SPACE, history, -n, False, ch), n
            to, n = self.fresh(ch, space=last == " ")
            return to, before + n + (0 if last == " " else count(last))
        if mode == kind:
            history, n = self.push(key[1], ch.encode())
            return (mode, history), n
        return self.fresh(ch)

    def run(self, state: State, text: str) -> tuple[State, int]:
        n = 0
        for ch in text:
            state, d = state[ch]
            n += d
        return state, n

    def chunk_map(self, text: str) -> tuple[str, int, State | None]:
        """(what precedes the first certain boundary, count after it, last state); no state: there is no boundary."""
        found = _FIRST.search(text)
        if found is None:
            return text, 0, None
        first, *words = _SYNC.split(text[found.start() :])
        state, n = self.run(self.start, first)
        if words:
            last = words.pop()
            n += sum(map(self.maps.__getitem__, words))
            state, d = self.run(self.start, " " + last)
            n += d
        return text[: found.start()], n, state

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        state, n = self.run(a[2], b[0])
        return a[0], a[1] + n + b[1], state if b[2] is None else b[2]

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """All prefixes' maps: pairs are composed, their prefixes found in the same way, and the places between them filled."""
        if len(maps) < 2:
            return maps
        upper = self.scan([self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])])
        return [maps[0]] + [upper[i // 2] if i % 2 else self.compose(upper[i // 2 - 1], maps[i]) for i in range(1, len(maps))]

    def cut(self, text: str, chunk: int) -> list[tuple]:
        """The maps of a text's chunks; all but the last have a certain boundary."""
        maps, heads = [], []
        for i in range(0, len(text), chunk):
            head, n, state = self.chunk_map(text[i : i + chunk])
            heads.append(head)
            if state is not None:
                maps.append(("".join(heads), n, state))
                heads = []
        return maps + ([("".join(heads), 0, None)] if heads else [])

    def scanned(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a text from the start state, by the maps of its chunks."""
        if not text:
            return 0
        head, n, _ = self.scan(self.cut(text, chunk))[-1]
        return self.run(self.start, head)[1] + n

    def count(self, text: str) -> int:
        """Tokens of a text."""
        total = 0
        parts = [text]
        if self.special_re and any(s in text for s in self.special):
            parts = self.special_re.split(text)
            total = len(parts) - 1
        return total + sum(map(self.scanned, parts))


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row of ``df``. No shuffle; memory is that of one text and the states."""
    ship(df.sparkSession)
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            texts = batch.column(1)
            found = pa.array([machine.count(t.as_py() or "") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), found], ["doc_id", "n_bytes", "n_tokens"])

    rows = id_text(df, id_col, text_col).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    out = count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

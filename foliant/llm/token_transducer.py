"""Token counts by compiled finite-state transducers.

A byte-level BPE vocabulary is compiled into two deterministic transducers:

* the *splitter* reads character classes and marks where a pre-token begins.  It has 13
  states, so a chunk's effect is a state map: an array that holds, for each entry state, the
  exit state.  State maps compose, and a parallel prefix scan (Hillis and Steele) over the
  maps of all chunks gives each chunk's entry state.
* the *merger* reads bytes and annotates every transition with the change of the number of
  tokens emitted so far.  Its states are determinised on demand.  A state holds, for every
  vocabulary-trie node that a token now open may have reached, the token before that place
  and the number of tokens up to there.  By the uniqueness of BPE encodings a sequence of
  tokens is the encoding of its text if and only if each neighbouring pair is the encoding of
  the pair's own text, so exactly one open candidate can end at each byte, and the count moves
  by a fixed amount.  A pre-token start resets the state, so the map of a chunk is constant
  after its first reset; only the head before it depends on the chunk to the left.

Chunks are lanes of numpy arrays and are run in lockstep.

Cases: a null text counts as empty, with 0 bytes and 0 tokens; repeated rows give repeated
results; texts of any length are read in whole; strings of special tokens inside a text are
one token each, as the tokenizer library's default has it; of merges of one rank the first place counts;
a null id stays null; an empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import column_values, map_arrow, slabs, text_bytes

CHUNK = 256
SLAB_BYTES = 3 << 20
MAX_STATES = 150_000

# Character classes of the splitter.
END, SPACE, WHITE, APOSTROPHE, LETTER, NUMBER, OTHER, STMD, LETTER_R, LETTER_V, LETTER_L, LETTER_E = range(12)
CLASSES = 12
# States of the splitter.
(START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, DONE) = range(13)
STATES = 13
BEGINS_HERE, BEGAN_BEFORE = 1, 2

# The code points with Unicode's White_Space property.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def character_classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[WHITE_SPACE] = WHITE
    table[0x20] = SPACE
    table[ord("'")] = APOSTROPHE
    for letters, kind in (("stmd", STMD), ("r", LETTER_R), ("v", LETTER_V), ("l", LETTER_L), ("e", LETTER_E)):
        for letter in letters:
            table[ord(letter)] = kind
    return table


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and marks of the splitter, both by state * CLASSES + class."""
    letters = {LETTER, STMD, LETTER_R, LETTER_V, LETTER_L, LETTER_E}
    opens = {SPACE: ONE_SPACE, WHITE: ONE_WHITE, APOSTROPHE: QUOTE, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS} | dict.fromkeys(letters, IN_LETTERS)
    after_space = opens | {APOSTROPHE: IN_OTHERS}
    contraction = {QUOTE_R: LETTER_E, QUOTE_V: LETTER_E, QUOTE_L: LETTER_L}

    def step(state: int, kind: int) -> tuple[int, int]:
        if kind == END:
            return START, BEGAN_BEFORE if state in contraction else 0
        if state in contraction:
            if kind == contraction[state]:
                return DONE, 0
            following, mark = step(IN_LETTERS, kind)
            return following, mark | BEGAN_BEFORE
        if state in (ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE):
            if kind in (SPACE, WHITE):
                return (RUN_SPACE if kind == SPACE else RUN_WHITE), 0
            before = BEGAN_BEFORE if state in (RUN_SPACE, RUN_WHITE) else 0
            if state in (ONE_SPACE, RUN_SPACE):
                return after_space[kind], before
            return opens[kind], before | BEGINS_HERE
        if state == QUOTE:
            if kind == STMD:
                return DONE, 0
            if kind in (LETTER_R, LETTER_V, LETTER_L):
                return {LETTER_R: QUOTE_R, LETTER_V: QUOTE_V, LETTER_L: QUOTE_L}[kind], 0
            state = IN_OTHERS
        stays = (state == IN_LETTERS and kind in letters) or (state == IN_NUMBERS and kind == NUMBER) or (state == IN_OTHERS and kind in (OTHER, APOSTROPHE))
        return (state, 0) if stays else (opens[kind], BEGINS_HERE)

    pairs = [step(s, c) for s in range(STATES) for c in range(CLASSES)]
    return np.array([p[0] for p in pairs], np.uint8), np.array([p[1] for p in pairs], np.uint8)


def lanes_of(values: np.ndarray, fill: int) -> np.ndarray:
    """A row for each step, a column for each chunk."""
    count = max(1, -(-len(values) // CHUNK))
    padded = np.full(count * CHUNK, fill, values.dtype)
    padded[: len(values)] = values
    return np.ascontiguousarray(padded.reshape(count, CHUNK).T)


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix scan: row i becomes the map of chunks 0 to i together."""
    scanned, reach = maps.copy(), 1
    while reach < len(scanned):
        scanned[reach:] = np.take_along_axis(scanned[reach:], scanned[:-reach].astype(np.intp), axis=1)
        reach *= 2
    return scanned


class Splitter:
    """Marks the starts of pre-tokens in a sequence of character classes."""

    HEAD = 16

    def __init__(self) -> None:
        self.next, self.mark = compile_splitter()
        self.wide = self.next.astype(np.intp) * CLASSES

    def state_maps(self, lanes: np.ndarray) -> np.ndarray:
        """For each chunk the exit state by entry state.  All states run until they meet."""
        count = lanes.shape[1]
        states = np.repeat((np.arange(STATES, dtype=np.intp) * CLASSES)[:, None], count, axis=1)
        for row in lanes[: self.HEAD]:
            states = self.wide[states + row]
        met = (states == states[0]).all(axis=0)
        one, rest = states[0].copy(), np.flatnonzero(~met)
        apart = states[:, rest]
        for row in lanes[self.HEAD :]:
            one = self.wide[one + row]
            if len(rest):
                apart = self.wide[apart + row[rest]]
        maps = np.repeat(one[:, None], STATES, axis=1)
        maps[rest] = apart.T
        return (maps // CLASSES).astype(np.uint8)

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Whether a pre-token starts at each position; END positions never are starts."""
        lanes = lanes_of(classes, END)
        total = compose_scan(self.state_maps(lanes))
        state = np.full(lanes.shape[1], START, np.intp)
        state[1:] = total[:-1, START]
        state *= CLASSES
        marks = np.empty(lanes.shape, np.uint8)
        for step, row in enumerate(lanes):
            key = state + row
            marks[step] = self.mark[key]
            state = self.wide[key]
        flat = marks.T.reshape(-1)[: len(classes)]
        begins = (flat & BEGINS_HERE) != 0
        begins[:-1] |= (flat[1:] & BEGAN_BEFORE) != 0
        return begins


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """The byte transducer of a BPE vocabulary, determinised on demand."""

    DEAD, INITIAL = 0, 1
    MISSING = -1
    SMALL = 48

    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        symbols = byte_symbols()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.spelled = {t: bytes(symbols[c] for c in s) for s, t in vocabulary.items() if all(c in symbols for c in s)}
        self.single = {v[0]: t for t, v in self.spelled.items() if len(v) == 1}
        self.ranks = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.child: dict[int, int] = {}
        self.token, self.parents = [-1], set()
        for t, spelling in self.spelled.items():
            node = 0
            for b in spelling:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.parents.add(node)
                node = self.child[key]
            self.token[node] = t
        self.below: list[tuple[int, ...] | None] = self.tokens_below()
        self.made = {whole: (rank, a, b) for (a, b), (rank, whole) in reversed(self.ranks.items())}
        self.alone: dict[int, bool] = {}
        self.open: dict[tuple[int, int], tuple[int, ...]] = {}
        self.reset()

    def tokens_below(self) -> list[tuple[int, ...] | None]:
        """For each trie node the tokens strictly below it, None where there are over SMALL."""
        parent = [0] * len(self.token)
        for key, node in self.child.items():
            parent[node] = key >> 8
        below: list[list[int] | None] = [[] for _ in self.token]
        for node in range(len(self.token) - 1, 0, -1):  # children have larger numbers
            own, up = below[node], below[parent[node]]
            if up is not None:
                if own is None or len(up) + len(own) >= self.SMALL:
                    below[parent[node]] = None
                else:
                    up += own + [self.token[node]] * (self.token[node] >= 0)
        return [None if x is None else tuple(x) for x in below]

    def still_open(self, node: int, before: int) -> tuple[int, ...] | None:
        """The tokens below a node that may follow `before`: what the node's future depends on, where they are few."""
        below = self.below[node]
        if below is None:
            return None
        key = (node, before)
        if key not in self.open:
            if len(self.open) > 2_000_000:
                self.open.clear()
            self.open[key] = tuple(t for t in below if self.pair_fits(before, t))
        return self.open[key]

    def reset(self) -> None:
        """Forget all states but the two fixed ones: a bound on memory, results stay the same."""
        self.number = {(): self.DEAD, ((0, -1, 0),): self.INITIAL}
        self.chains: list[tuple] = list(self.number)
        self.table = np.full(4096 * 256, self.MISSING, np.int32)
        self.table[:256] = self.DEAD << 8 | 128
        self.room = MAX_STATES

    def fit_table(self) -> None:
        """Make the table as long as the states need, whatever their number."""
        if len(self.chains) * 256 > len(self.table):
            wanted = min(2 * len(self.table), (MAX_STATES + 65536) * 256)
            grown = np.full(max(wanted, (len(self.chains) + 4096) * 256), self.MISSING, np.int32)
            grown[: len(self.table)] = self.table
            self.table = grown

    def keep(self, states: np.ndarray) -> np.ndarray:
        """Forget all states but these, the live ones; returns their new numbers.  There is room for as many again, at least."""
        live, place = np.unique(states, return_inverse=True)
        chains = [self.chains[s] for s in live.tolist()]
        self.reset()
        fresh = []
        for chain in chains:
            name = tuple((n, b if (may := self.still_open(n, b)) is None else may, d) for n, b, d in chain[:-1]) + chain[-1:]
            if name not in self.number:
                self.number[name] = len(self.chains)
                self.chains.append(chain)
            fresh.append(self.number[name])
        self.fit_table()
        self.room = max(MAX_STATES, 2 * len(self.chains))
        return np.array(fresh, np.int64)[place]

    def encode(self, text: bytes) -> list[int]:
        """The tokens of a short text, by merging the pair of lowest rank first."""
        tokens = [self.single[b] for b in text]
        while len(tokens) > 1:
            best = min((self.ranks.get(p, (1 << 60,)) for p in zip(tokens, tokens[1:])), default=(1 << 60,))
            if best[0] == 1 << 60:
                break
            out, i = [], 0
            while i < len(tokens):
                if i + 1 < len(tokens) and self.ranks.get((tokens[i], tokens[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(tokens[i])
                    i += 1
            tokens = out
        return tokens

    def stands_alone(self, token: int) -> bool:
        """Whether a token is the encoding of its own text."""
        if token not in self.alone:
            self.alone[token] = self.encode(self.spelled[token]) == [token]
        return self.alone[token]

    def pair_fits(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their text together; left -1: right alone.

        The tokens that touch at the seam are followed back in time, from the last merge to the
        first.  The pair fails if at some time the two that touch could merge before one of them
        is taken into its own token; of equal merges the leftmost comes first.
        """
        if not self.stands_alone(right):
            return False
        if left < 0:
            return True
        never = 1 << 60
        left_taken = right_taken = never
        while True:
            across = self.ranks.get((left, right))
            if across is not None and across[0] < left_taken and across[0] <= right_taken:
                return False
            left_made, right_made = self.made.get(left), self.made.get(right)
            if left_made is None and right_made is None:
                return True
            if right_made is None or (left_made is not None and left_made[0] > right_made[0]):
                left_taken, left = left_made[0], left_made[2]
            else:
                right_taken, right = right_made[0], right_made[1]

    def transition(self, state: int, byte: int) -> int:
        """Add the transition to the table: the next state in the upper bits, the change of the count, plus 128, in the lower eight."""
        chosen, change, longer = -1, 0, []
        for node, before, behind in self.chains[state]:
            after = self.child.get(node << 8 | byte)
            if after is None:
                continue
            token = self.token[after]
            if chosen < 0 and token >= 0 and self.pair_fits(before, token):
                chosen, change = token, behind + 1
            if after in self.parents and (may := self.still_open(after, before)) != ():
                longer.append((after, before, behind, may))
        chain = (*((n, b, d - change) for n, b, d, _ in longer), (0, chosen, 0))
        # States are the same if the same tokens may end in future, with the same counts.
        name = (*((n, b if may is None else may, d - change) for n, b, d, may in longer), (0, chosen, 0))
        following = self.number.get(name)
        if following is None:
            following = self.number[name] = len(self.chains)
            self.chains.append(chain)
            self.fit_table()
        self.table[state << 8 | byte] = value = following << 8 | change + 128
        return value

    def steps(self, keys: np.ndarray) -> np.ndarray:
        """The table's entries, made where they are missing."""
        values = self.table[keys]
        if len(values) and values.min() < 0:
            for key in np.unique(keys[values < 0]).tolist():
                self.transition(key >> 8, key & 255)
            values = self.table[keys]
        return values

    def changes(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The change of the number of tokens at each byte."""
        if len(self.chains) > MAX_STATES:
            self.reset()
        lanes, resets = lanes_of(data, 0), lanes_of(starts, True)
        first = np.where(resets.any(axis=0), resets.argmax(axis=0), CHUNK)
        out = np.zeros(lanes.shape, np.int8)
        state = np.full(lanes.shape[1], self.DEAD, np.int64)
        for step in range(CHUNK):  # every chunk from its first reset on: there its state map is constant
            if len(self.chains) > self.room:
                state = self.keep(state)
            state[resets[step]] = self.INITIAL
            values = self.steps(state << 8 | lanes[step])
            out[step] = (values & 255) - 128
            state = (values >> 8).astype(np.int64)
        known = first < CHUNK
        waiting = np.flatnonzero(first > 0)
        waiting = waiting[waiting > 0]
        while len(waiting):  # the heads before it, from the exit state of the chunk to the left
            ready = waiting[known[waiting - 1]]
            at = state[ready - 1]
            for step in range(int(first[ready].max())):
                on = first[ready] > step
                if not on.all():
                    whole = first[ready] == CHUNK
                    keep = on | whole
                    ready, at, on = ready[keep], at[keep], on[keep]
                if len(self.chains) > self.room:
                    state, at = np.split(self.keep(np.concatenate([state, at])), [len(state)])
                values = self.steps(at << 8 | lanes[step, ready])
                out[step, ready] = (values & 255) - 128
                at = (values >> 8).astype(np.int64)
            whole = first[ready] == CHUNK
            state[ready[whole]] = at[whole]
            waiting_known = known.copy()
            waiting_known[ready[whole]] = True
            waiting = waiting[~known[waiting - 1]]
            known = waiting_known
        return out.T.reshape(-1)[: len(data)]


class TokenCounter:
    """Counts tokens of texts for one vocabulary file of the `tokenizers` library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.splitter, self.merger = Splitter(), Merger(spec["model"]["vocab"], spec["model"]["merges"])
        self.classes = character_classes()
        specials = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, specials))) if specials else None
        self.safe = re.compile(rb"[a-zA-Z](?= [a-zA-Z])")

    def pieces(self, text: bytes) -> tuple[list[bytes], int]:
        """Parts that are split by themselves, and the number of special tokens between them."""
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        out = []
        for part in parts:
            while len(part) > SLAB_BYTES and (cut := self.safe.search(part, SLAB_BYTES // 2)):
                out.append(part[: cut.end()])
                part = part[cut.end() :]
            out.append(part)
        return out, len(parts) - 1

    def count_slab(self, parts: list[bytes]) -> np.ndarray:
        """Tokens of each part."""
        text = "\0".join(p.decode("utf-8", "replace") for p in parts)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        widths = np.ones(len(points), np.int64)
        for bound in (0x80, 0x800, 0x10000):
            widths += points >= bound
        places = np.cumsum(widths) - widths
        lengths = np.array([len(p) for p in parts], np.int64)
        begin = np.cumsum(lengths + 1) - lengths - 1
        data = np.frombuffer(b"\0".join(parts), np.uint8)
        ends = np.zeros(len(data), bool)
        ends[begin[1:] - 1] = True
        kinds = self.classes[points]
        kinds[ends[places]] = END
        starts = np.zeros(len(data), bool)
        starts[places[self.splitter.starts(kinds)]] = True
        starts[begin[1:] - 1] = True
        changes = self.merger.changes(data, starts)
        changes[ends] = 0
        total = np.concatenate([[0], np.cumsum(changes, dtype=np.int64)])
        return total[begin + lengths] - total[begin]

    def count(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text."""
        parts, owners, counts = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            own, counts[i] = self.pieces(text)
            parts += own
            owners += [i] * len(own)
        for a, b in slabs(parts, SLAB_BYTES):
            if any(parts[a:b]):
                for owner, n in zip(owners[a:b], self.count_slab(parts[a:b]).tolist()):
                    counts[owner] += n
        return counts


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The counter of a vocabulary file; one for each Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of each text.

    `vocabulary` is the path of a byte-level BPE vocabulary in the format of the `tokenizers`
    library; each executor must have it there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            texts = column_values(batch, "_text")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(own.count(texts), pa.int64())], [id_col, "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_bytes(text_col).alias("_text"))
    return map_arrow(rows, f"{id_col} long, n_bytes long, n_tokens long", run).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))

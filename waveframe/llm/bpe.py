"""BPE encoding and decoding by a tokenization automaton.

A merge list is compiled into a deterministic automaton over tokens that accepts exactly the
tokenizations which the merges yield. It starts as one state with an arc to itself for each symbol.
Merges are added in their order; the gadget of a merge (a, b) gives the arcs labelled `a` a state of
their own without arc `b`, and adds an arc labelled `ab` wherever an arc `a` leaves, which leads
to a copy of the state behind `b`. So the state behind an arc depends on its label alone, and one
state a token is enough. A copy is kept as what it was copied from and when, an added arc as the
arc beside which it was added and when, so the automaton is as large as the merge list.

Every prefix of a word is spelled by one path only. Encoding goes through a word once: at each
place it looks up the arcs whose label ends there and takes the one that its start state has.
The labels of the path are the ids; decoding emits the labels of the ids.

Normalising and splitting into words are the tokenizer file's own. Where the file splits at white
space, a text falls into chunks that it handles independently; each task keeps a bounded table from
chunk to ids in two generations, so that frequent chunks stay.

Defined results: null and empty texts and texts of white space have no ids; a text's own special-token strings
become those tokens, as in the library; null ids decode to an empty text; repeated rows count
each; an empty table gives none; other columns pass through untouched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP_BYTES, steps

#: White space at which every chunk ends; what other white space does is left to the file's own rules.
CHUNK = re.compile("[^ \t\n\r\x0b\x0c]+")
#: Entries of a generation of the table, and of arcs that are known to be there or not.
TABLE_ENTRIES = 250_000
#: Longer chunks are encoded each time and not kept.
KEPT_CHARS = 64
NEVER = 1 << 62
HEAD = 3
#: Chunks of ASCII and Latin-1 letters, which normalising only lower-cases, and their words as SPLIT has them.
LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
LATIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Byte-level vocabularies write a byte as itself if it is visible, the others as 256 and on.
SEEN_BYTES = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in SEEN_BYTES)}


def model_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Automaton:
    """States and arcs after all merges: made[t] is when t's arcs were added, beside those of left[t],
    with a copy of the state behind right[t]; cut[(s, t)] is when state s lost arc t."""

    def __init__(self, symbols: Iterable[str], merges: Iterable[tuple[str, str]], end: str = ""):
        self.left: dict[str, str] = {}
        self.right: dict[str, str] = {}
        self.made: dict[str, int] = dict.fromkeys(symbols, -1)
        self.cut: dict[tuple[str, str], int] = {}
        for now, (a, b) in enumerate(merges):
            self._merge(a, b, now)
        self.end = end
        #: By its first symbols, how far the longest label goes in a word.
        self.reach: dict[str, int] = {}
        for label in self.made:
            own = label.removesuffix(end)
            self.reach[own[:HEAD]] = max(len(own), self.reach.get(own[:HEAD], 0))
        self.known: dict[str | None, dict[str, bool]] = {}
        self.n_known = 0

    def _merge(self, a: str, b: str, now: int) -> None:
        if a not in self.made or b not in self.made or a + b in self.made:
            raise ValueError(f"merge {now} of {a!r} and {b!r} uses a token before it is made, or makes one twice")
        if not self._leaves(a, b):
            raise ValueError(f"merge {now} of {a!r} and {b!r} can never be reached")
        ab = a + b
        self.left[ab], self.right[ab], self.made[ab], self.cut[a, b] = a, b, now, now

    def _leaves(self, state: str | None, arc: str) -> bool:
        """Whether the arc leaves the state: it did where the state was copied from and beside which arc it was added, and no cut came between."""
        until = NEVER
        while state is not None:
            label, by = arc, NEVER
            while label is not None:
                # a cut counts if the copy was made after it, and if what was added beside the arc came no earlier
                if (at := self.cut.get((state, label), NEVER)) < until and at <= by:
                    return False
                by, label = self.made[label], self.left.get(label)
            until, state = self.made[state], self.right.get(state)
        return True

    def has_arc(self, state: str | None, arc: str) -> bool:
        """As `_leaves`, which is asked once for each pair while the table of known arcs has room."""
        found = self.known.get(state, {}).get(arc)
        if found is None:
            if self.n_known >= TABLE_ENTRIES:
                self.known, self.n_known = {}, 0
            found = self.known.setdefault(state, {})[arc] = self._leaves(state, arc)
            self.n_known += 1
        return found

    def path(self, word: str) -> list[str]:
        """The labels of the one path that spells the word, whose last symbol has the automaton's `end` behind it.

        The longest arc goes first. A place reached is reached by the only path that spells the word so far, so one
        from which the word can't be finished is left for good: no place is gone through twice.
        """
        if (whole := word + self.end) in self.made:
            return [whole]
        n, made, reach = len(word), self.made, self.reach
        out: list[str] = []
        starts: list[int] = []
        left = set()
        at, state, to = 0, None, min(n, reach.get(word[:HEAD], HEAD))
        while True:
            known = self.known.get(state) or {}
            while to > at:
                arc = word[at:to] if to < n else whole[at:]
                if arc in made and to not in left:
                    found = known.get(arc)
                    if self.has_arc(state, arc) if found is None else found:
                        break
                to -= 1
            else:
                if not out:
                    raise ValueError(f"no path spells {word!r}: a symbol is unknown")
                left.add(at)
                out.pop()
                to, at, state = at - 1, starts.pop(), out[-1] if out else None
                continue
            out.append(arc)
            if to == n:
                return out
            starts.append(at)
            at, state, to = to, arc, min(n, to + reach.get(word[to : to + HEAD], HEAD))


class Table:
    """A bounded table in two generations: what is used stays when the older one goes."""

    def __init__(self, entries: int, make):
        self.entries, self.make = entries, make
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes:
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.make(key)
            if len(key) <= KEPT_CHARS:
                if len(self.young) >= self.entries:
                    self.old, self.young = self.young, {}
                self.young[key] = value
        return value


class Encoder:
    """A tokenizer file: its own normaliser and splitter, the automaton of its merges, its special tokens."""

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model, added = held["model"], held["added_tokens"]
        plain = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "ignore_merges": False, "byte_fallback": False}
        if any((model.get(k) or None) != (v or None) for k, v in plain.items()) or any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError(f"{path}: not a plain BPE of bytes with plain special tokens")
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        joined = {a + b for a, b in merges}
        self.automaton = Automaton((t for t in model["vocab"] if t not in joined), merges, self.end)
        self.ids = model["vocab"]
        self.packed = {t: np.int32(i).tobytes() for t, i in self.ids.items()}
        self.special = {x["content"]: x["id"] for x in added}
        self.specials = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) or "(?!)")
        self.labels = {i: t for t, i in (self.ids | self.special).items()}
        own = Tokenizer.from_file(path)
        self.normalizer, self.splitter, self.decoder = own.normalizer, own.pre_tokenizer, own.decoder
        self.chunked = splits_at_spaces(held)
        self.chunks, self.words = Table(entries, self._segment), Table(entries, self._word)

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.automaton.path(word)))

    def _split(self, part: str) -> list[str]:
        """The words of a text without special tokens, each a string of one character a byte."""
        if self.chunked and LATIN.fullmatch(part):
            return [w if w.isascii() else w.encode().decode("latin-1").translate(BYTES) for w in LATIN_WORD.findall(part.lower())]
        part = self.normalizer.normalize_str(part) if self.normalizer else part
        return [w for w, _ in self.splitter.pre_tokenize_str(part)] if self.splitter else [part]

    def _segment(self, chunk: str) -> bytes:
        get, out, at = self.words.get, [], 0
        for found in self.specials.finditer(chunk):
            if found.start() > at:
                out.extend(map(get, self._split(chunk[at : found.start()])))
            out.append(np.int32(self.special[found[0]]).tobytes())
            at = found.end()
        if at < len(chunk):
            out.extend(map(get, self._split(chunk[at:] if at else chunk)))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as bytes of int32."""
        split = [CHUNK.findall(t) if self.chunked else [t] for t in texts]
        known = self.chunks.young
        found = {chunk: known.get(chunk) or self.chunks.get(chunk) for chunk in set().union(*split)}
        get = found.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the ids, joined as the file says; ids without a label have none."""
        try:
            labels = list(map(self.labels.__getitem__, ids))
        except KeyError:
            labels = [t for i in ids if (t := self.labels.get(i)) is not None]
        return self.decoder.decode(labels) if self.decoder else " ".join(labels)


def splits_at_spaces(held: dict) -> bool:
    """Whether the file turns white space into spaces and keeps only matches that hold none of them."""
    def flat(x, inner):
        return [] if not x else [y for z in x[inner] for y in flat(z, inner)] if x["type"] == "Sequence" else [x]

    spaces = any(x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in flat(held["normalizer"], "normalizers"))
    kinds = [x["type"] for x in flat(held["normalizer"], "normalizers")], [x["type"] for x in flat(held["pre_tokenizer"], "pretokenizers")]
    split = next((x for x in flat(held["pre_tokenizer"], "pretokenizers") if x["type"] == "Split"), None)
    return bool(kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and spaces and split["pattern"] == {"Regex": SPLIT} and split["behavior"] == "Removed" and split["invert"])


@lru_cache(maxsize=2)
def loaded(path: str, entries: int = TABLE_ENTRIES) -> Encoder:
    return Encoder(path, entries)


def _lists(found: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))


def decoded_texts(encoder: Encoder, lists: pa.Array) -> pa.Array:
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    upto = np.cumsum(sizes).tolist()
    ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).tolist()
    return pa.array([encoder.decode(ids[lo:hi]) for lo, hi in zip([0, *upto], upto)], pa.string())


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", decoded: str | None = None, table_entries: int = TABLE_ENTRIES) -> DataFrame:
    """docs with `ids array<int>` of the whole text, without special tokens around it; columns of that name are replaced.

    With `decoded`, also a column of that name with the decoded ids, made in the same task.
    """
    path = path or model_path()
    more = [decoded] if decoded else []
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    out = T.StructType([*[docs.schema[c] for c in kept], T.StructField(ids, T.ArrayType(T.IntegerType())), *[T.StructField(c, T.StringType()) for c in more]])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path, table_entries)
        for batch in batches:
            for lo, hi, part in steps(batch.column(at), STEP_BYTES // 2):
                lists = _lists(encoder.encode(part.to_pylist()))
                both = [lists, decoded_texts(encoder, lists)] if decoded else [lists]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *both], names=[*kept, ids, *more])

    return docs.select(*kept).mapInArrow(run, out)


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """rows with `decoded string`: the labels of the ids. The column `decoded` is replaced if there is one."""
    path = path or model_path()
    kept = [c for c in rows.columns if c != decoded]
    out = T.StructType([*[rows.schema[c] for c in kept], T.StructField(decoded, T.StringType())])
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path)
        for batch in batches:
            places = np.cumsum(np.asarray(batch.column(at).value_lengths().fill_null(0))) // (STEP_BYTES // 4)
            lo = 0
            while lo < len(places):
                hi = max(lo + 1, int(np.searchsorted(places, places[lo], side="right")))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, decoded_texts(encoder, part.column(at))], names=[*kept, decoded])
                lo = hi

    return rows.select(*kept).mapInArrow(run, out)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    both = encode(docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")), path, decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Token ids of whole texts, by distinct words.

A text's ids are those of its pieces between white space, because the tokenizer's pre-tokenizer
never lets a token cross white space. So every batch encodes its distinct pieces only, and a
cache of bounded bytes keeps them for the worker's next batches. A tokenizer of other settings encodes
whole texts.
"""

from __future__ import annotations

import ctypes
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from daybreak.llm.common import mix64, place_keys, table_of

#: Bytes of words and ids that a worker keeps for its next batches; then it begins anew.
CACHE_BYTES = 64 << 20
_encoders: dict[str, Encoder] = {}
#: The tokenizer settings under which a text's ids are those of its pieces between white space, and words are told apart by their ends.
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>"},
}


#: Anything but letters which the normalizer leaves letters: U+0130 in lower case ends in a mark, some scripts' letters fall into letter and mark.
_UNSTABLE = r"[^\x{0}-\x{12F}\x{131}-\x{52F}\x{3041}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]"


def by_word(settings: dict) -> bool:
    """Whether texts may be encoded word by word under these settings of a tokenizer."""
    steps = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = steps[0].get("pattern") == _BY_WORD["pattern"] and steps[0].get("invert") and steps[0].get("behavior") == "Removed"
    bytes_only = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space")
    model = {k: settings["model"].get(k) for k in _BY_WORD["model"]}
    plain = all(not set(t["content"]) & set(" \t\n\x0b\x0c\r") and not t["lstrip"] and not t["rstrip"] for t in settings.get("added_tokens", []))
    return bool(split and bytes_only and plain and settings.get("normalizer") == _BY_WORD["normalizer"] and model == _BY_WORD["model"])


class Encoder:
    """Encodes whole texts: word by word where the tokenizer's settings allow it, by the library's own call otherwise."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        vocabulary = self.tokenizer.get_vocab()
        self.by_word = by_word(settings)
        #: Ids that end a pre-token, by which a run of encoded words is cut into words again.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.tails = [np.empty(0, "<u4"), *(np.asarray(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4") for x in ".,")]
        self._forget()

    def _forget(self) -> None:
        self.names, self.order = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.begins, self.sizes, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def _alone(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for ids in rows for i in ids], "<u4"), np.fromiter(map(len, rows), np.int64, len(rows))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, encoded in runs; a run whose words can't be told apart is encoded word by word."""
        flat, sizes = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for i in range(0, len(words), 512):
            run = words[i : i + 512]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(run)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(run) or cuts[-1] != len(ids):
                ids, own = self._alone(run)
            else:  # a word of letters makes one pre-token at least, so each made one
                own = np.diff(cuts, prepend=0)
            flat.append(ids)
            sizes.append(own)
        return np.concatenate(flat), np.concatenate(sizes)

    def _known(self, pieces: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct pieces begin in `flat`, and their number; letters marks words of nothing else.

        Pieces are told apart by 64 bits of a hash and their length.
        """
        if self.flat.nbytes + 32 * len(self.names) > CACHE_BYTES:
            self._forget()
        names = _names(pieces)
        turn = np.argsort(names)
        at = np.empty(len(names), np.int64)
        at[turn] = np.searchsorted(self.names, names[turn])
        there = np.zeros(len(names), bool)
        inside = at < len(self.names)
        there[inside] = self.names[at[inside]] == names[inside]
        for encode, new in ((self._words, np.flatnonzero(~there & letters)), (self._alone, np.flatnonzero(~there & ~letters))):
            if len(new):
                ids, sizes = encode(pieces.take(pa.array(new)).to_pylist())
                self.begins = np.append(self.begins, len(self.flat) + np.cumsum(sizes) - sizes)
                self.sizes = np.append(self.sizes, sizes)
                self.flat = np.append(self.flat, ids)
                own = names[new]
                order = np.argsort(own)
                place = np.searchsorted(self.names, own[order])
                self.names = np.insert(self.names, place, own[order])
                self.order = np.insert(self.order, place, order + len(self.sizes) - len(sizes))
        at[turn] = np.searchsorted(self.names, names[turn])
        which = self.order[at]
        return self.begins[which], self.sizes[which]

    def column(self, texts: pa.Array, end_id: int | None, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids of these rows one after the other, ids of each row); end_id closes every row."""
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = texts.cast(pa.large_string()).fill_null("")
        lengths = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        row, n = 0, len(texts)
        while row < n:
            end = max(row + 1, int(np.searchsorted(lengths, (lengths[row - 1] if row else 0) + max_bytes, side="right")))
            part = texts.slice(row, end - row)
            if self.by_word and end == row + 1 and lengths[row] - (lengths[row - 1] if row else 0) > 2 * max_bytes:
                pieces = [self._encode(x, None)[0] for x in _parts(part, max_bytes)]
                ids = np.concatenate([*pieces, np.asarray([] if end_id is None else [end_id], "<u4")])
                yield row, end, ids, np.array([len(ids)])
            else:
                yield row, end, *(self._encode(part, end_id) if self.by_word else self._plain(part, end_id))
            row = end

    def _plain(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        close = [] if end_id is None else [end_id]
        rows = [np.asarray([*x.ids, *close], "<u4") for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate(rows), np.array([len(x) for x in rows])

    def _encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds -= bounds[0]
        flat, sizes = self._pieces(words.dictionary)
        if end_id is not None:
            flat, sizes = np.append(flat, np.uint32(end_id)), np.append(sizes, 1)
            index = np.insert(index, bounds[1:], len(sizes) - 1)
            bounds += np.arange(len(bounds))
        begins = np.cumsum(sizes) - sizes
        per_word = sizes[index]
        written = np.concatenate([[0], np.cumsum(per_word)])
        source = np.repeat(begins[index] - written[:-1], per_word)
        source += np.arange(written[-1])
        return flat[source], np.diff(written[bounds])

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces one after the other, and their number.

        A word of letters is looked up in lower case (that of ASCII letters) and without a closing full stop or comma, whose ids follow.
        """
        if not len(pieces):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        closed = [pc.ends_with(pieces, pattern=x) for x in (".", ",")]
        stems = pc.if_else(pc.or_(*closed), pc.utf8_slice_codeunits(pieces, 0, -1), pieces)
        letters = pc.and_(pc.utf8_is_alpha(stems), pc.invert(pc.match_substring_regex(stems, _UNSTABLE)))
        stems = pc.if_else(pc.and_(letters, pc.string_is_ascii(stems)), pc.ascii_lower(stems), stems)
        keyed = pc.if_else(letters, stems, pieces).dictionary_encode()
        tail = np.where(letters.to_numpy(zero_copy_only=False), closed[0].to_numpy(zero_copy_only=False) + 2 * closed[1].to_numpy(zero_copy_only=False), 0)
        of = keyed.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        by_letters = np.zeros(len(keyed.dictionary), bool)
        by_letters[of] = letters.to_numpy(zero_copy_only=False)
        begins, sizes = self._known(keyed.dictionary, by_letters)
        flat = np.concatenate([self.flat, *self.tails])
        tails = np.array([len(x) for x in self.tails])
        begins, sizes = np.append(begins, len(self.flat) + np.cumsum(tails) - tails), np.append(sizes, tails)
        parts = np.stack([of, len(keyed.dictionary) + tail], axis=1).ravel()
        each = sizes[parts]
        ends = np.cumsum(each)
        source = np.arange(int(ends[-1])) + np.repeat(begins[parts] - ends + each, each)
        return flat[source], each[::2] + each[1::2]


def _names(pieces: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string and its length."""
    _, offsets, data = pieces.buffers()
    offsets = np.frombuffer(offsets, np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    sizes = np.diff(offsets)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    some = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), np.uint64)
    if len(some):
        begins = (offsets - offsets[0])[some]
        place = np.arange(len(flat)) - np.repeat(begins, sizes[some])
        sums = np.add.reduceat((flat + np.uint64(1)) * place_keys(int(sizes.max()))[place], begins)
        out[some] = mix64(sums + sizes[some].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def _parts(text: pa.Array, max_bytes: int) -> Iterator[pa.Array]:
    """One long text in parts that are cut at white space; a part without any is as long as it is."""
    data = np.frombuffer(text[0].as_buffer(), np.uint8)
    space = table_of(b" \t\n\x0b\x0c\r")
    begin = 0
    while begin < len(data):
        end = begin + max_bytes
        while end < len(data) and not (found := np.flatnonzero(space[data[end : end + max_bytes]])).size:
            end += max_bytes
        end = end + int(found[0]) if end < len(data) else len(data)
        yield pa.array([data[begin:end].tobytes().decode()], pa.large_string())
        begin = end


def encoder(path: str) -> Encoder:
    """The worker's encoder for this vocabulary file; its cache serves all tasks of the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Gives back what the worker's encoders hold, for steps of the same worker that only read ids."""
    _encoders.clear()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))

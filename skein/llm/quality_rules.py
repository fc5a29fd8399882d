"""Quality rules on tokeniser fertility.

Public vocabularies show how natural a text is: text like what they were made from needs few tokens a
character, hardly any single bytes, and a broad mix of tokens. For every document this measures the
characters per token of two vocabularies, the share of byte-fallback tokens and the entropy of its
tokens, and rejects what falls outside the bands of its language (or of its script, for a language
without bands of its own). Words are encoded one by one, each with the mark of a word's start.

Defined results: a null, empty or blank text has no words and fails the base rules; a null or unknown
language takes its script's bands; equal rows get equal verdicts; an empty table gives no rows; other
columns pass through ``keep`` untouched.
"""

from __future__ import annotations

import unicodedata
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.caches import only
from skein.llm.common import Renamed, long_rows

#: Distinct words whose encodings a worker keeps (about 200 bytes each).
KEPT_WORDS = 150_000
#: Fixed bands by language, else by script: least characters per token of the byte-fallback
#: vocabulary and of the byte-level one, largest share of byte-fallback tokens, least entropy of the
#: tokens in bits relative to that of as many different tokens (or of FULL, in longer texts).
BANDS = {
    "en": (1.85, 1.8, 0.02, 0.725),
    "fr": (1.75, 1.68, 0.02, 0.708),
    "de": (1.9, 1.8, 0.02, 0.708),
    "es": (1.72, 1.6, 0.02, 0.705),
    "LATIN": (1.5, 1.4, 0.05, 0.69),
    "OTHER": (0.3, 0.3, 0.9, 0.5),
}
FULL = 384
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
MEASURES = "chars_per_token double, chars_per_byte_token double, byte_share double, entropy double, band string, kept boolean"
_CONT = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


class Vocabularies(dict):
    """word (bytes) -> 32-bit numbers as bytes: how many ids the byte-fallback vocabulary has for it, how
    many of them are bytes, how many tokens the byte-level one, characters, then the ids."""

    def __init__(self, piece_path: str, bpe_path: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        super().__init__()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.is_byte = {i for i in range(self.pieces.get_piece_size()) if self.pieces.is_byte(i)}
        with open(bpe_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        ids = self.pieces.encode(text, num_threads=1)
        found = array("i", [len(ids), sum(i in self.is_byte for i in ids), len(self.bpe.encode_ordinary(f" {text}")), len(text), *ids]).tobytes()
        if len(self) < KEPT_WORDS:
            self[word] = found
        return found


def vocabularies(piece_path: str, bpe_path: str) -> Vocabularies:
    return only(f"fertility {piece_path} {bpe_path}", lambda: Vocabularies(piece_path, bpe_path))


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def repeat_words(ids: np.ndarray) -> int:
    """Words in windows of three that occur twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    top = int(ids.max()) + 1
    if top < 1 << 21:
        keys = (ids[:-2] * top + ids[1:-1]) * top + ids[2:]
    else:  # two at a time, so that 64 bits do for any number of words
        pairs = np.unique(ids[:-1] * top + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * top + ids[2:]
    order = np.argsort(keys)
    found = keys[order]
    same = found[1:] == found[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[1:] |= same
    twice[:-1] |= same
    at, covered = order[twice], np.zeros(n + 2, bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def base_measures(text: bytes, words: list[bytes], ids: np.ndarray) -> tuple:
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = repeat_words(ids)
    return (n, len(text.translate(None, _CONT + _SPACE)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeats, n < 50 or 100 * repeats > 50 * n)


def script(text: bytes) -> str:
    """LATIN if most of the first letters of the distinct words are."""
    marks = [c for c in {w[:1] for w in text.decode("utf-8", "replace").split()} if c.isalpha()]
    latin = sum(unicodedata.name(c, "").startswith("LATIN") for c in marks)
    return "LATIN" if 2 * latin >= len(marks) else "OTHER"


def _entropies(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Entropy in bits of each run of tokens, over the greatest that many tokens can have."""
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    out = np.zeros(len(ends))
    for i in range(len(ends)):
        if sizes[i] > 1:
            counts = np.bincount(tokens[starts[i] : ends[i]]) if sizes[i] > 4096 else np.unique(tokens[starts[i] : ends[i]], return_counts=True)[1]
            p = counts[counts > 0] / sizes[i]
            out[i] = -(p * np.log2(p)).sum() / np.log2(min(sizes[i], FULL))
    return out


def measure(texts: list[bytes], langs: list[str | None], vocab: Vocabularies, bands: dict) -> list[tuple]:
    """A row of BASE and MEASURES for each text."""
    numbers, words, ids = _Numbers(), [], []
    for text in texts:
        found = text.split()  # on the six ASCII separators
        words.append(found)
        ids.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
    known = [vocab[w] for w in numbers]
    flat = np.frombuffer(b"".join(known), np.int32).astype(np.int64)
    starts = np.cumsum([0, *(len(k) // 4 for k in known)])[:-1]
    n_tokens, n_bytes, n_bpe, n_chars = (flat[starts + i] for i in range(4))
    firsts = starts + 4
    rows = []
    for text, lang, found, own in zip(texts, langs, words, ids, strict=True):
        base = base_measures(text, found, own)
        if not found:
            rows.append((*base, 0.0, 0.0, 0.0, 0.0, "", False))
            continue
        sizes, chars = n_tokens[own], float(n_chars[own].sum())
        total = max(1, int(sizes.sum()))
        place = np.repeat(firsts[own] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        per_piece, per_bpe, byte_share = chars / total, chars / max(1, int(n_bpe[own].sum())), float(n_bytes[own].sum()) / total
        entropy = float(_entropies(flat[place], np.array([len(place)]))[0])
        band = lang if lang in bands else script(text)
        least_piece, least_bpe, most_bytes, least_entropy = bands[band]
        kept = not base[-1] and per_piece >= least_piece and per_bpe >= least_bpe and byte_share <= most_bytes and entropy >= least_entropy
        rows.append((*base, per_piece, per_bpe, byte_share, entropy, band, bool(kept)))
    return rows


def _judged(own: Renamed, piece_path: str, bpe_path: str, bands: dict) -> DataFrame:
    """own's rows with a struct ``_rules`` of BASE and MEASURES; nothing is shuffled."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    long_rows(own.rows.sparkSession)
    kind = StructType.fromDDL(f"{BASE}, {MEASURES}")
    arrow = to_arrow_type(kind)
    schema = StructType([*own.rows.schema.fields]).add("_rules", kind)
    names, text_at = schema.names, own.names.index("text")
    lang_at = own.names.index("lang") if "lang" in own.names else None

    def run(batches):
        from skein.llm.tokens import slices

        vocab = vocabularies(piece_path, bpe_path)
        for part in slices(batches, 2_000_000, f"_c{text_at}"):
            texts = [(t or "").encode() for t in part.column(text_at).to_pylist()]
            langs = part.column(lang_at).to_pylist() if lang_at is not None else [None] * len(texts)
            rows = measure(texts, langs, vocab, bands)
            found = pa.array([dict(zip(kind.names, r, strict=True)) for r in rows], arrow)
            yield pa.RecordBatch.from_arrays([*part.columns, found], names=names)

    return own.rows.mapInArrow(run, schema)


def judged(docs: DataFrame, piece_path: str, bpe_path: str, bands: dict = BANDS) -> DataFrame:
    """doc_id, BASE and MEASURES of every row."""
    own = Renamed(docs)
    return _judged(own, piece_path, bpe_path, bands).select(own["doc_id"].alias("doc_id"), "_rules.*")


def keep(docs: DataFrame, piece_path: str, bpe_path: str, bands: dict = BANDS) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    own = Renamed(docs)
    return own.back(_judged(own, piece_path, bpe_path, bands).where("_rules.kept"))

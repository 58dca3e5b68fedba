"""Quality rules, line first.

Every line is judged by rules on punctuation, navigation and boilerplate; failing lines are removed;
a document is rejected if its base measures fail or if too much of its text was removed. All
measures come from the words and lines of whole texts, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.bytesio import joined, owner, pair_numbers, word_numbers, word_spans

SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,;:!?"
#: punctuation of other scripts; its presence in a line is enough
OTHER_PUNCTUATION = "\u3001\u3002\uff0c\uff0e\uff01\uff1f\uff1a\uff1b\u060c\u061b\u061f\u06d4\u0964\u2026"


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules; all are documented parameters.

    A line fails
    - as debris, if symbols are at least `symbols` of its characters;
    - for punctuation, if it has at least `bare_words` words and not one punctuation mark;
    - as navigation, with `separators` or more of | and > and at least `separator_share` of them a word;
    - as boilerplate, if it holds a phrase as whole words (letter case of A-Z aside) and the phrase is
      at least one in `phrase_share` of its words, so that a paragraph on copyright stays;
    - as a repeat of an earlier line of the document.
    Lines without words are neither kept nor lost. A document is rejected if failed lines hold more
    than `lost` of its word characters or fewer than `least_words` words are left.
    """

    symbols: float = 0.1
    bare_words: int = 20
    separators: int = 3
    separator_share: float = 0.2
    phrase_share: int = 8
    lost: float = 0.5
    least_words: int = 30
    phrases: tuple[str, ...] = field(
        default=(
            "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
            "click here", "sign in", "log in", "subscribe to our", "javascript is disabled", "enable javascript",
            "skip to content", "back to top", "share this", "read more", "licensed under", "copyright",
            "alle rechte vorbehalten", "nutzungsbedingungen", "hier klicken", "jetzt anmelden", "weiterlesen",
            "nach oben", "impressum", "cliquez ici", "lire la suite", "se connecter", "en savoir plus", "mentions legales",
            "todos los derechos reservados", "haga clic", "leer mas", "volver arriba", "aviso legal",
        )
    )


BASE_LEAST_WORDS = 50
BASE_MOST_REPEATED = 50  # percent of words


def _bytes_in(which: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(which)] = True
    return out


_SYMBOL, _SEPARATOR, _MARK = _bytes_in(SYMBOLS), _bytes_in(b"|>"), _bytes_in(PUNCTUATION)
_LETTER_START = ~_bytes_in(bytes(range(0x80, 0xC0)))  # all but UTF-8 continuation bytes
_IN_WORD = _bytes_in(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100)))


def _places(text: bytes, part: bytes) -> list[int]:
    out, at = [], text.find(part)
    while at >= 0:
        out.append(at)
        at = text.find(part, at + 1)
    return out


def measured(texts: list[bytes], rules: LineRules) -> dict[str, np.ndarray]:
    """Base and line measures of each text, and the removed lines as (document, start, end).

    Words and lines are compared as they are, never by a hash.
    """
    n = len(texts)
    buffer, doc_starts, doc_ends = joined(texts)
    zero = np.zeros(n, np.int64)
    out = {k: zero.copy() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "words_left")}
    starts, ends = word_spans(buffer)
    if not len(starts):
        out["lines"] = np.zeros((0, 3), np.int64)
        return out
    doc = owner(doc_starts, starts)
    n_words = np.bincount(doc, minlength=n)
    out["n_words"] = n_words

    def sums(mask: np.ndarray) -> np.ndarray:
        got = np.zeros(len(buffer) + 1, np.int64 if len(buffer) >= 2**31 else np.int32)
        np.cumsum(mask, out=got[1:], dtype=got.dtype)
        return got

    chars = sums(_LETTER_START[buffer])
    word_chars = (chars[ends] - chars[starts]).astype(np.int64)
    out["word_chars"] = np.bincount(doc, word_chars, n).astype(np.int64)
    symbols = sums(_SYMBOL[buffer])
    out["n_symbols"] = (symbols[doc_ends] - symbols[doc_starts]).astype(np.int64)

    # words in 3-word windows that occur twice or more in their text
    if len(starts) >= 3:
        word = word_numbers(texts)
        three = pair_numbers(pair_numbers(word[:-1], word[1:])[:-1], word[2:])
        at = np.flatnonzero(doc[2:] == doc[:-2])
        own = pair_numbers(doc[at], three[at])
        hit = at[np.bincount(own)[own] > 1] if len(at) else at
        marked = np.zeros(len(starts), bool)
        for shift in range(3):
            marked[hit + shift] = True
        out["n_repeat_words"] = np.bincount(doc[marked], minlength=n)

    # lines: a document's start or the byte after a newline, up to the next newline or its end
    breaks = np.flatnonzero(buffer == 0x0A)
    line_starts = np.sort(np.concatenate([doc_starts, breaks + 1]), kind="stable")
    line_ends = np.sort(np.concatenate([doc_ends, breaks]), kind="stable")
    first_word = np.searchsorted(starts, line_starts)
    after_word = np.searchsorted(starts, line_ends)
    full = after_word > first_word
    line_starts, line_ends, first_word, after_word = (x[full] for x in (line_starts, line_ends, first_word, after_word))
    line_doc, line_words = doc[first_word], after_word - first_word
    whole = buffer.tobytes()
    repeated, seen, of = np.zeros(len(line_starts), bool), set(), -1
    for i, (d, a, b) in enumerate(zip(line_doc.tolist(), line_starts.tolist(), line_ends.tolist(), strict=True)):
        if d != of:
            of, seen = d, set()
        line = whole[a:b]
        if line in seen:
            repeated[i] = True
        seen.add(line)
    out["n_dup_lines"] = np.bincount(line_doc[repeated], minlength=n)

    failed = repeated | (symbols[line_ends] - symbols[line_starts] >= rules.symbols * (chars[line_ends] - chars[line_starts]))
    bars = sums(_SEPARATOR[buffer])
    bars = bars[line_ends] - bars[line_starts]
    failed |= (bars >= rules.separators) & (bars >= rules.separator_share * line_words)
    marks = sums(_MARK[buffer])
    bare = (marks[line_ends] == marks[line_starts]) & (line_words >= rules.bare_words)
    if bare.any():
        for mark in OTHER_PUNCTUATION:
            at = np.array(_places(whole, mark.encode()), np.int64)
            bare[np.searchsorted(line_starts, at, side="right") - 1] = False
    failed |= bare
    low = whole.lower()
    for phrase in rules.phrases:
        size, share = len(phrase.encode()), len(phrase.split()) * rules.phrase_share
        for at in _places(low, phrase.encode()):
            i = int(np.searchsorted(line_starts, at, side="right")) - 1
            if i < 0 or at + size > line_ends[i] or line_words[i] > share:
                continue
            failed[i] |= (at == 0 or not _IN_WORD[low[at - 1]]) and not _IN_WORD[low[at + size]]
    upto = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(word_chars, out=upto[1:])
    line_chars = upto[after_word] - upto[first_word]
    out["lost_chars"] = np.bincount(line_doc[failed], line_chars[failed], n).astype(np.int64)
    out["words_left"] = n_words - np.bincount(line_doc[failed], line_words[failed], n).astype(np.int64)
    out["lines"] = np.stack([line_doc[failed], (line_starts - doc_starts[line_doc])[failed], (line_ends - doc_starts[line_doc])[failed]], 1)
    return out


def verdicts(m: dict[str, np.ndarray], rules: LineRules) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept of each text."""
    base = (m["n_words"] < BASE_LEAST_WORDS) | (100 * m["n_repeat_words"] > BASE_MOST_REPEATED * m["n_words"])
    kept = ~base & (m["lost_chars"] <= rules.lost * m["word_chars"]) & (m["words_left"] >= rules.least_words)
    return base, kept


def cleaned(text: bytes, spans: np.ndarray) -> bytes:
    """The text without the given lines and their newlines."""
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end + 1  # the newline goes too
    out.append(text[at:])
    whole = b"".join(out)
    return whole[:-1] if at > len(text) and whole.endswith(b"\n") else whole


def _groups(batch: pa.RecordBatch, column: str = "text", bound: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with at most `bound` bytes of text each, or one row, and their texts."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    upto = np.cumsum(sizes)
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] - sizes[at] + bound, side="right")))
        part = batch.slice(at, end - at)
        yield part, [t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()]
        at = end


def _cleaned(texts: list[bytes], which: np.ndarray, lines: np.ndarray) -> list[str]:
    at = np.searchsorted(lines[:, 0], np.arange(len(texts) + 1))
    return [cleaned(texts[i], lines[at[i] : at[i + 1], 1:]).decode("utf-8", "replace") for i in which]


def quality(docs: DataFrame, rules: LineRules = LineRules(), clean: bool = False) -> DataFrame:
    """Measures and verdict of every document.

    docs: doc_id, text; other columns are ignored. Returns doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words (long), base_failed, kept (boolean), n_lost_lines, lost_chars (long)
    and, with clean, clean_text: the text without its failed lines. A null text counts as empty:
    all measures 0, base_failed true, kept false. Repeated rows get a row each; very long texts are
    measured whole; an empty table gives no rows. Texts are measured a mebibyte at a time.
    """
    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, n_lost_lines long, lost_chars long"
    ) + (", clean_text string" if clean else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _groups(batch):
                m = measured(texts, rules)
                base, kept = verdicts(m, rules)
                lost = np.bincount(m["lines"][:, 0], minlength=len(texts))
                columns = [part.column("doc_id")]
                columns += [pa.array(m[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                columns += [pa.array(base), pa.array(kept), pa.array(lost.astype(np.int64)), pa.array(m["lost_chars"])]
                if clean:
                    columns.append(pa.array(_cleaned(texts, range(len(texts)), m["lines"]), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def kept_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that the rules keep, cleaned of failed lines; same columns as docs.

    The verdict travels with its row, so rows with equal or no ids are judged apart; n_chars is
    counted anew if docs has it. Null and empty texts fail the base measures and go.
    """
    names, types = docs.columns, dict(docs.dtypes)
    fields = ", ".join(f"`{c}` {types[c]}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _groups(batch):
                m = measured(texts, rules)
                kept = np.flatnonzero(verdicts(m, rules)[1])
                clean = _cleaned(texts, kept, m["lines"])
                columns = list(part.take(pa.array(kept)).columns)
                columns[names.index("text")] = pa.array(clean, pa.string())
                if "n_chars" in names:
                    i = names.index("n_chars")
                    columns[i] = pa.array([len(t) for t in clean], columns[i].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, fields)

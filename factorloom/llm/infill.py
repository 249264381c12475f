"""Fill-in-middle documents: a text is cut into prefix, middle and suffix, which are written in another order between sentinels.

One Aho-Corasick automaton over a whole text finds the only places that matter: the sentinels (a
text that has one is left plain) and the ASCII white space, at which the class of characters changes
between word and space.  Between two of these sparse events nothing happens, so the number of units
in a gap is arithmetic on its length; the place after any number of units, and the words before any
place, are looked up by rank among the events.  No array with an entry for each character is made.

Units are code points, or runs of one class (words and the spaces between them).  The form and the
cuts come from a digest of the document's id, so each run of the job gives the same result.
"""

from __future__ import annotations

from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, kept_by_worker, text_of

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
SPACES = " \t\n\x0b\x0c\r"
#: Of 100 documents that many get a form other than plain, and of 100 of these that many start with the suffix.
RATE, SUFFIX_FIRST = 90, 20
UNITS = ("codepoint", "run")


@kept_by_worker(maxsize=1)
def _automaton():
    """The sentinels by their number, white space as -1."""
    found = ahocorasick.Automaton()
    for i, s in enumerate(SENTINELS):
        found.add_word(s, i)
    for c in SPACES:
        found.add_word(c, -1)
    found.make_automaton()
    return found


class Events:
    """Where a text has sentinels (place of the first character, number) and where its words start and end."""

    def __init__(self, text: str):
        hits = list(_automaton().iter(text))
        self.n = len(text)
        self.sentinels = [(at - 2, k) for at, k in hits if k >= 0]
        space = np.array([at for at, k in hits if k < 0], np.int64)
        # a gap between two spaces (or an end of the text) that holds a character is a word
        left, right = np.concatenate([[-1], space]) + 1, np.concatenate([space, [self.n]])
        word = right > left
        self.starts, self.ends = left[word], right[word]

    def words(self, lo: int, hi: int) -> int:
        """Words of the slice lo:hi; one that a border cuts counts on both sides."""
        return max(0, int(np.searchsorted(self.starts, hi) - np.searchsorted(self.ends, lo, "right"))) if lo < hi else 0

    def units(self, unit: str) -> int:
        return self.n if unit == "codepoint" else len(self._borders)

    def place(self, k: int, unit: str) -> int:
        """Characters of the first k units."""
        return k if unit == "codepoint" else int(self._borders[k - 1]) if k else 0

    @cached_property
    def _borders(self) -> np.ndarray:
        """The ends of the runs of words and of spaces."""
        both = np.unique(np.concatenate([self.starts, self.ends, [self.n]]))
        return both[both > 0]


def cut(text: str, draws: tuple[int, int, int, int], unit: str = "codepoint") -> tuple:
    """(units, form, output, lengths of prefix and middle in characters, their words) of a text, by four numbers drawn for it."""
    events = Events(text)
    n = events.units(unit)
    if not text or events.sentinels or draws[2] % 100 >= RATE:
        return n, "plain", text, None, None, None, None
    a, b = sorted(events.place(h % (n + 1), unit) for h in draws[:2])
    lengths = (a, b - a, events.words(0, a), events.words(a, b))
    if draws[3] % 100 < SUFFIX_FIRST:
        return n, "spm", "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b])), *lengths
    return n, "psm", "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b])), *lengths


def joined(output: str, form: str) -> str:
    """The text that ``cut`` was given, from its output and form.

    The sentinels' own characters can't overlap with the text's to give another one, so the events
    of the output are its three sentinels.
    """
    if form == "plain":
        return output
    at = Events(output).sentinels
    if [k for _, k in at] != ([0, 1, 2] if form == "psm" else [1, 0, 2]) or at[0][0]:
        raise ValueError(f"not a document of the form {form}")
    x, y, z = output[3 : at[1][0]], output[at[1][0] + 3 : at[2][0]], output[at[2][0] + 3 :]
    return x + z + y if form == "psm" else y + z + x


def draws(id_col: str = "doc_id", seed: int = 1) -> Column:
    """Four unsigned 32-bit numbers from the sha256 of seed and id (a null id: as the empty text)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def transform(docs: DataFrame, unit: str = "codepoint", seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, prefix_words, middle_words, output) of each row.

    Null texts count as empty; an empty text, and one with a sentinel, is plain and has null lengths.
    Rows of one id are cut by the same numbers; repeated rows give repeated results.  Other columns
    are not read.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), draws(id_col, seed).alias("draws"))
    fields = [("n", "long"), ("form", "string"), ("output", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("prefix_words", "long"), ("middle_words", "long")]
    types = [pa.string() if t == "string" else pa.int64() for _, t in fields]

    def run(batches):
        for batch in batches:
            made = [cut(text, h, unit) for text, h in zip(batch["text"].to_pylist(), batch["draws"].to_pylist())]
            columns = zip(*made) if made else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, t) for c, t in zip(columns, types)]], ["doc_id", *[f for f, _ in fields]])

    return arrow_map(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{f} {t}" for f, t in fields))


def restore(transformed: DataFrame) -> DataFrame:
    """The rows of ``transform``'s result with the column ``text``, rebuilt from ``output`` and ``form``."""
    from pyspark.sql.types import StringType

    def run(batches):
        for batch in batches:
            text = [joined(o, f) for o, f in zip(batch["output"].to_pylist(), batch["form"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "text"])

    return arrow_map(transformed, run, type(transformed.schema)([*transformed.schema.fields]).add("text", StringType()))


def infill_digest(docs: DataFrame) -> DataFrame:
    """``transform`` with digests of the output and of the text restored from it, for each row."""
    made = restore(transform(docs))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("text").alias("restored_sha256"), "prefix_words", "middle_words")


#: The same rows in DuckDB's SQL.
SQL = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), k AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
    ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM h
), c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k
), p AS (
  SELECT *, left(t, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256,
  CASE WHEN form <> 'plain' THEN len(regexp_extract_all(prefix, '[^\x20\x09-\x0D]+')) END AS prefix_words,
  CASE WHEN form <> 'plain' THEN len(regexp_extract_all(middle, '[^\x20\x09-\x0D]+')) END AS middle_words
FROM p
"""

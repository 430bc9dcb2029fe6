"""Token counts with a whole-token shortcut.

Before the scan it is proved, by encoding each string of the vocabulary alone, which of them come out as one token. In the tasks a text is normalised and cut into
pre-tokens as the tokenizer's file says; a pre-token that is in the proved set counts one, and only the others go through the merges, each once
a block of texts (with a bounded memory of earlier ones). Strings of special tokens inside a text are single tokens, as the library takes them.

Null texts count as empty: 0 bytes, 0 tokens. Very long texts are counted whole. Rows with a null doc_id and repeated rows are counted like others, and equal texts alike; exactly 2048 tokens are not
over the limit. Other columns, of any name, are not read. An empty table gives an empty result."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .blocks import batch, text_blocks
from .common import table

LIMIT = 2048
#: Below this code point Python's tables of case, composition and classes agree with the library's; other texts are cut by the library itself.
PLAIN = "ƀ"
MEMORY = 400_000


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def proved_whole(spec: str) -> frozenset[str]:
    """Pre-tokens that encode alone as exactly one token."""
    from tokenizers import Tokenizer

    tok, chars, end = Tokenizer.from_str(spec), byte_chars(), json.loads(spec)["model"].get("end_of_word_suffix") or ""
    surfaces = set()
    for s in tok.get_vocab(with_added_tokens=False):
        s = s.removesuffix(end) if end and s.endswith(end) else s
        try:
            surfaces.add(bytes(chars[c] for c in s).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    ordered = sorted(surfaces)
    found = tok.encode_batch(ordered, add_special_tokens=False)
    return frozenset(s for s, e in zip(ordered, found, strict=True) if s and len(e.ids) == 1)


def counter(spec: str, whole: frozenset[str]) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts."""
    import unicodedata

    import regex
    from tokenizers import Tokenizer

    tok, parsed = Tokenizer.from_str(spec), json.loads(spec)
    pattern = regex.compile(parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
    special = re.compile("|".join(re.escape(t["content"]) for t in parsed["added_tokens"]) or r"(?!)")
    cost: dict[str, int] = dict.fromkeys(whole, 1)
    shown = {b: c for c, b in byte_chars().items()}

    def cut(text: str) -> list[str]:
        if text.isascii():
            return pattern.findall(text.lower())
        if max(text) < PLAIN:
            return pattern.findall(unicodedata.normalize("NFC", text).lower())
        text = tok.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]

    def count(texts: list[str]) -> list[int]:
        specials = [len(special.findall(t)) if "<" in t else 0 for t in texts]
        cuts = [[p for part in special.split(t) for p in cut(part)] if n else cut(t) for t, n in zip(texts, specials, strict=True)]
        if new := list({p for c in cuts for p in c if p not in cost}):
            if len(cost) > MEMORY + len(whole):
                cost.clear()
                cost.update(dict.fromkeys(whole, 1))
                new = list({p for c in cuts for p in c if p not in cost})
            # a piece that normalising would change again goes to the merges as it is
            odd = [] if all(map(str.isascii, new)) else [p for p in new if not unicodedata.is_normalized("NFC", p)]
            cost.update({p: len(tok.model.tokenize("".join(shown[b] for b in p.encode()))) for p in odd})
            new = [p for p in new if p not in cost] if odd else new
            cost.update(zip(new, (len(e.ids) for e in tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return [n + sum(map(cost.__getitem__, c)) for n, c in zip(specials, cuts, strict=True)]

    return count


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text)."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((spec, proved_whole(spec)))  # a few MB, as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = counter(*shared.value)
        for b in batches:
            for lo, hi, _, at in text_blocks(b.column("text")):
                texts = [t or "" for t in b.column("text").slice(lo, hi - lo).to_pylist()]
                n = count(texts)
                yield batch(doc_id=b.column("doc_id").slice(lo, hi - lo), n_bytes=pa.array(at[1:] - at[:-1], pa.int64()), n_tokens=pa.array(n, pa.int64()), over_limit=pa.array([x > limit for x in n]))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))

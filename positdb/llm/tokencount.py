"""Token counts by a whole-token shortcut.

Most chunks of a text are vocabulary strings that the library turns into exactly one token.  Which ones do is proved
once, on the driver, by encoding every vocabulary string alone (``whole_tokens``); the proved set is as large as the
vocabulary at most and goes to every worker.  A worker cuts a text at ASCII white space, counts proved chunks directly
and has the library merge the rest, whose counts it remembers in a table of bounded size.

Cutting at ASCII white space never changes a count: the normaliser composes nothing across white space, the
pre-tokeniser drops it, and the special strings hold none.

Nulls count as empty; empty texts have 0 tokens; repeated rows give repeated results; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from positdb.llm.common import map_arrow, utf8

#: Remembered chunks a worker holds beside the proved ones; beyond that it starts anew.
REMEMBERED = 300_000

#: The tokeniser's pre-token pattern (fixed value).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def whole_tokens(tokenizer_path: str) -> list[bytes]:
    """The vocabulary strings, as UTF-8, that the library encodes alone as one token and that hold no white space."""
    from tokenizers import Tokenizer, decoders

    tok = Tokenizer.from_file(tokenizer_path)
    plain, suffix = decoders.ByteLevel(), "</w>"
    texts = sorted({plain.decode([t.removesuffix(suffix)]) for t in tok.get_vocab() if t.endswith(suffix)})
    texts = [t for t in texts if t and "�" not in t and t.encode().split() == [t.encode()]]
    return [t.encode() for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)) if len(e.ids) == 1]


class Merges(dict):
    """Tokens of a pre-token, remembered: 1 for the proved ones, else as many as the library's merges leave."""

    def __init__(self, tok, proved: list[bytes]) -> None:
        super().__init__()
        self.model, self.proved = tok.model, {p.decode(): 1 for p in proved}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(256 + i) for i, b in enumerate(others)}  # byte-level vocabularies write bytes so
        self.update(self.proved)

    def __missing__(self, piece: str) -> int:
        if len(self) > REMEMBERED + len(self.proved):
            self.clear()
            self.update(self.proved)
        n = self[piece] = len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))
        return n


class ChunkCounts(dict):
    """Tokens of a chunk of UTF-8 bytes: 1 for the proved ones, else the sum over its pre-tokens, remembered.

    Chunks with letters beyond the Latin blocks, or with special strings, go to the library as they are, so that no
    difference between Unicode tables can show.
    """

    def __init__(self, tokenizer_path: str, proved: list[bytes]) -> None:
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tok, self.proved = Tokenizer.from_file(tokenizer_path), proved
        self.pieces = Merges(self.tok, proved)
        self.cut = regex.compile(PIECE).findall
        self.update(dict.fromkeys(proved, 1))

    def __missing__(self, chunk: bytes) -> int:
        if len(self) > REMEMBERED + len(self.proved):
            self.clear()
            self.update(dict.fromkeys(self.proved, 1))
        text = chunk.decode()
        if max(text) >= "\u0250" or "\x85" in text or "\xa0" in text or "<|" in text:
            n = len(self.tok.encode(text, add_special_tokens=False).ids)
        else:
            n = sum(map(self.pieces.__getitem__, self.cut(text.lower())))
        self[chunk] = n
        return n


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    proved = spark.sparkContext.broadcast(whole_tokens(tokenizer_path))  # bounded by the vocabulary

    def make():
        counts = ChunkCounts(tokenizer_path, proved.value)

        def work(batch):
            texts = utf8(batch, "text")
            n = [sum(map(counts.__getitem__, t.split())) for t in texts]
            return {"id": batch.column("id"), "n_bytes": [len(t) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return work

    slim = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    kind = slim.schema["id"].dataType.simpleString()
    out = map_arrow(slim, make, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)

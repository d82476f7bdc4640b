"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from offerloom.llm import common

#: Distinct chunks kept by one Python worker; the table starts anew beyond that.
KEPT = 200_000
_loaded: dict[str, "PieceTable"] = common.worker_table("piece_codec")


class PieceTable:
    """Ids of each distinct marked word of a BPE model whose pieces start, never end, with markers.

    Such a piece cannot reach over a marker into the next word, nor over a line feed if no piece
    holds one, so the ids of a text are those of its chunks in order. A chunk is a run of markers
    or line feeds with the word after it. __init__ checks both properties of the model.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("pieces of this model cross white space; words cannot be encoded apart")
        self.end, self.marker = self.sp.eos_id(), self.sp.piece_to_id("▁")
        self.starts, self.shown = {i for i, p in enumerate(pieces) if p[:1] == "▁"}, [str(i) for i in range(len(pieces))]
        self.chunk = re.compile(r" +[^ \n]*|\n+[^ \n]*")
        self.ids: dict[str, tuple[int, ...]] = {}
        self.text: dict[str, str] = {}

    def learn(self, new: list[str]) -> None:
        """Segment chunks that have not been met yet; words after one space go to the library together."""
        plain, rest = [], []
        for c in new:
            (plain if c[0] == " " and len(c) > 1 and c[1] != " " else rest).append(c)
        for i in range(0, len(plain), 64):
            part = plain[i : i + 64]
            # no piece reaches over a marker, so each id that starts with one starts a chunk
            ids = self.sp.encode("".join(part)[1:], num_threads=1)
            shown, cut = list(map(self.shown.__getitem__, ids)), [k for k, x in enumerate(ids) if x in self.starts]
            for c, a, b in zip(part, cut, cut[1:] + [len(ids)]):
                self.ids[c], self.text[c] = tuple(ids[a:b]), " ".join(shown[a:b])
        # the library puts one marker in front: it stands for a chunk's first space
        for c in rest:
            if c == " ":
                ids = [self.marker]
            else:
                ids = self.sp.encode(c[1:] if c[0] == " " else c)
                ids = ids[1:] if c[0] == "\n" else ids
            self.ids[c], self.text[c] = tuple(ids), " ".join(map(str, ids))

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        parts = [self.chunk.findall((" " + t).replace("▁", " ")) if t else [] for t in texts]
        new = set(chain.from_iterable(parts)) - self.ids.keys()
        if len(self.ids) + len(new) > KEPT:
            self.ids.clear()
            self.text.clear()
            new = set(chain.from_iterable(parts))
        self.learn(list(new))
        out, ids_of, text_of = [], self.ids.__getitem__, self.text.__getitem__
        for p in parts:
            ids = list(chain.from_iterable(map(ids_of, p)))
            ids.append(self.end)
            out.append((ids, " ".join([*map(text_of, p), str(self.end)])))
        return out


def _pieces(path: str) -> PieceTable:
    if path not in _loaded:
        _loaded[path] = PieceTable(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str, keep_ids: bool = False, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with flags also ids and decoded.

    Ids are the library's for the whole text with an end id; decoding is the library's on those
    ids. A null or empty text has the end id only and decodes to an empty text. Repeated rows
    each give a row; other columns are ignored. No shuffle.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids + ["decoded"] * keep_text
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    def run(batches):
        table = _pieces(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for i in range(0, batch.num_rows, 256):
                found = table.encode(texts.slice(i, 256).to_pylist())
                decoded = [table.sp.decode(ids) for ids, _ in found]
                cols = [
                    batch.column(0).slice(i, 256),
                    pa.array([len(ids) for ids, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s in found]),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                ]
                if keep_ids:
                    cols.append(pa.array([ids for ids, _ in found], pa.list_(pa.int32())))
                if keep_text:
                    cols.append(pa.array(decoded, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(id_col, text_col).mapInArrow(common.lean(run, "piece_codec"), schema)

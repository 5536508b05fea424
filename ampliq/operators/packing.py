"""Aligned reads packed by sample: like reads share most letters, so together they take few bytes.

Packed reads move through shuffles and checkpoints as one row of a sample (or a
few, where they were packed in parts), and become rows where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.packs import squeeze_texts, stretch_texts

#: The column that holds the letters of a row's reads.
PACKED = "alns"
#: Letters of reads given out together.
BLOCK = 1 << 22


def packed_type(rows: DataFrame) -> T.StructType:
    """Schema of packed reads: the sample, lists of the other columns, the letters."""
    own = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in rows.schema.fields if f.name not in ("sample", "aln")]
    return T.StructType([rows.schema["sample"], *own, T.StructField(PACKED, T.BinaryType())])


def pack_reads(aln: DataFrame) -> DataFrame:
    """Rows (sample, aln, others) that follow each other in one row of their sample. No row moves, so a sample may have several."""
    rest = [c for c in aln.columns if c not in ("sample", "aln")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column("sample").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1]).astype(np.int32)
            at = pa.array(np.append(first, batch.num_rows).astype(np.int32))
            texts = batch.column("aln").to_pylist()
            alns = [squeeze_texts(texts[a:b]) for a, b in zip(first, [*first[1:], batch.num_rows])]
            own = [pa.ListArray.from_arrays(at, batch.column(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([batch.column("sample").take(pa.array(first)), *own, pa.array(alns, pa.binary())], ["sample", *rest, PACKED])

    return aln.mapInArrow(pack, packed_type(aln))


def unpack_reads(packs: DataFrame, lists: tuple[str, ...] = ("read_id", "rn")) -> DataFrame:
    """The rows again, with ``aln``; columns other than ``lists`` belong to the sample and stand in each of its rows."""
    fields = [f for f in packs.schema.fields if f.name != PACKED]
    out = [T.StructField(f.name, f.dataType.elementType) if f.name in lists else f for f in fields]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, texts, sizes, letters = 0, [], [], 0
            for k, raw in enumerate(batch.column(PACKED)):
                own = stretch_texts(raw.as_py())
                texts += own
                sizes.append(len(own))
                letters += sum(len(t or "") for t in own)
                if letters > BLOCK or k + 1 == batch.num_rows:
                    which = pa.array(np.repeat(np.arange(low, k + 1), sizes))
                    cols = [batch.column(f.name).slice(low, k + 1 - low).flatten() if f.name in lists else batch.column(f.name).take(which) for f in fields]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())], [*(f.name for f in fields), "aln"])
                    low, texts, sizes, letters = k + 1, [], [], 0

    return packs.mapInArrow(unpack, T.StructType([*out, T.StructField("aln", T.StringType())]))

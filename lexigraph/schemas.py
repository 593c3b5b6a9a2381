"""Declared schemas of the inputs; nothing is inferred at run time."""

from pyspark.sql import types as T

S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


WORD = struct(word=S, type=S, start=I, length=I)
ARTICLE = struct(fact=S, meta=struct(accusation=T.ArrayType(S)), cut=T.ArrayType(WORD))
TOKEN = struct(index=S, word=S, pos=S, lac_pos=S, dep=S, head=S, prefix=S, begin=I, end=I, ver=S, _type=S)
SENTENCE = struct(index=S, tokens=T.MapType(S, TOKEN), manual_relations=T.ArrayType(T.ArrayType(S)), _type=S)
TRIPLE = struct(a=S, r=S, b=S)
PATTERN = struct(pattern=S, frequency=L)
SAMPLE = struct(cut_text=S, e1=S, e2=S, tag=I)
NODE = struct(label=S, name=S, subgraph=S)
EDGE = struct(src_label=S, src=S, type=S, dst_label=S, dst=S)
ANNOTATED = struct(sentences=T.ArrayType(struct(index=I, tokens=T.ArrayType(struct(index=I, word=S, pos=S)))))

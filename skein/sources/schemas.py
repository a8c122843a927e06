"""Schemas of manifests, evaluation rows, segments and logs."""

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, t, True) for k, t in fields.items()])


_S, _D = StringType(), DoubleType()
MANIFEST = _struct(utt_id=_S, audio_path=_S, text=_S, language=_S, task=_S, duration=_D, source=_S, speaker=_S, translation=_S)
SHARD = StructType([*MANIFEST.fields, StructField("samples", IntegerType(), True)])
EVALUATION = _struct(utt_id=_S, ref=_S, hyp=_S, avg_logprob=_D)
SEGMENT = _struct(start=FloatType(), end=FloatType(), text=_S, tokens=ArrayType(IntegerType()), avg_logprob=FloatType(), no_speech_prob=FloatType(), temperature=FloatType(), language=_S)
WAVE = _struct(utt_id=_S, wave=ArrayType(FloatType()))
METRICS = _struct(step=LongType(), time=_D, loss=_D, lr=_D, grad_norm=_D, steps_per_sec=_D, dev_loss=_D)

"""Fixed schemas of the data model (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

TOKENS = T.ArrayType(T.StringType())
UTTERANCES = T.ArrayType(TOKENS)

# Channel names: the caller side (attacker or helper) and the victim side.
CALLER = "caller"
VICTIM = "victim"
CHANNELS = (CALLER, VICTIM)

# Raw-turn layout of a stored dataset: one row per paired turn.
RAW_TURNS = T.StructType(
    [
        T.StructField("conv_id", T.StringType(), False),
        T.StructField("seq", T.IntegerType(), False),
        T.StructField("caller", T.StringType(), True),
        T.StructField("victim", T.StringType(), True),
        T.StructField("label", T.IntegerType(), True),
    ]
)

# A generated conversation: numbered turns, caller key depends on the type.
RESPONSE_TURN = T.StructType(
    [
        T.StructField("Attacker", T.StringType(), True),
        T.StructField("Helper", T.StringType(), True),
        T.StructField("Victim", T.StringType(), True),
    ]
)
RESPONSE = T.MapType(T.StringType(), RESPONSE_TURN)

# Streaming message: both channels' word lists so far.
MESSAGE = T.StructType(
    [
        T.StructField("conv_id", T.StringType(), True),
        T.StructField("seq", T.LongType(), True),
        T.StructField("event_ts", T.TimestampType(), True),
        T.StructField("Attacker_Helper", TOKENS, True),
        T.StructField("Victim", TOKENS, True),
    ]
)

# One channel's message in the two-source stream.
CHANNEL_MESSAGE = T.StructType(
    [
        T.StructField("conv_id", T.StringType(), True),
        T.StructField("seq", T.LongType(), True),
        T.StructField("event_ts", T.TimestampType(), True),
        T.StructField("text", T.StringType(), True),
    ]
)

VOCABULARY = T.StructType(
    [
        T.StructField("token", T.StringType(), False),
        T.StructField("cnt", T.LongType(), False),
        T.StructField("idx", T.IntegerType(), False),
    ]
)

"""Explicit schemas (never inferred)."""

from pyspark.sql import types as T

# M1: one chat message; conv_id/turn are our keys (list order made explicit).
MESSAGE = T.StructType([
    T.StructField("conv_id", T.LongType(), False),
    T.StructField("turn", T.LongType(), False),
    T.StructField("role", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("simplify", T.StringType(), True),
    T.StructField("simplified_message", T.StringType(), True),
])

# M3: request body.
REQUEST = T.StructType([
    T.StructField("message", T.StringType(), True),
    T.StructField("simplify", T.StringType(), True),
])

# M4: response envelope.
RESULT = T.StructType([
    T.StructField("status", T.StringType(), True),
    T.StructField("answer", T.StringType(), True),
    T.StructField("simplifiedMessage", T.StringType(), True),
])
RESPONSE = T.StructType([
    T.StructField("success", T.BooleanType(), True),
    T.StructField("error", T.StringType(), True),
    T.StructField("data", T.StructType([T.StructField("result", RESULT, True)]), True),
])

# Driver tables used by the operators.
CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType(), True),
    T.StructField("turn", T.LongType(), True),
    T.StructField("role", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
])
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("lang", T.StringType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("n_chars", T.LongType(), True),
])
EMBEDDINGS = T.StructType([
    T.StructField("vec_id", T.LongType(), True),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    T.StructField("label", T.IntegerType(), True),
])
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType(), True),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("props", T.StringType(), True),
])

TABLE_SCHEMAS = {
    "conversations": CONVERSATIONS,
    "documents": DOCUMENTS,
    "embeddings": EMBEDDINGS,
    "events": EVENTS,
}

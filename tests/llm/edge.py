"""Edge-case rows shared by the tests."""

from pyspark.sql import types as T

PROSE = ("The quick brown fox jumps over the lazy dog near the river bank while seven children watch from the old "
         "wooden bridge and laugh. Later that day they all walk home together, eat bread with cheese, and tell the "
         "story to their parents before the sun goes down behind the hills.")
LONG = " ".join(f"word{i % 7919} other{i % 104729}" for i in range(60_000)) + "."
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    T.StructField("row", T.StringType()), T.StructField("t", T.StringType()), T.StructField("h", T.LongType()),
    T.StructField("size", T.IntegerType()), T.StructField("kept", T.BooleanType()), T.StructField("uid", T.LongType()),
    T.StructField("score", T.DoubleType()), T.StructField("copies", T.LongType())])


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), "r", "t", 1, 2, True, 3, 0.5, 4)


def edge_docs(spark):
    rows = [row(1, PROSE), row(2, None), row(3, ""), row(4, " \n\t "), row(5, "Short."), row(6, LONG), row(7, PROSE),
            row(8, PROSE, None, None), row(None, "An id is missing here."), row(9, "no letters: 123 456"),
            row(10, PROSE + " One more closing sentence."), row(11, "12345"), row(12, "Tie."), row(12, "Tie.")]
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)

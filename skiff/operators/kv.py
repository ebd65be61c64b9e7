"""Last-write-wins state of a key-value command log, and the replies to its commands.

Log: seq, args (array of texts). Commands count when all upper or all lower case."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _command(log: DataFrame) -> DataFrame:
    c = F.try_element_at("args", F.lit(1))
    known = F.when(c.isin("PING", "ping"), "PING").when(c.isin("SET", "set"), "SET").when(c.isin("GET", "get"), "GET").otherwise("")
    return log.withColumn("cmd", known).withColumn("n", F.size("args"))


def state(log: DataFrame) -> DataFrame:
    """(k, v) after the log; partial aggregation, no window."""
    sets = _command(log).where("cmd = 'SET' and n = 3")
    return sets.groupBy(F.element_at("args", 2).alias("k")).agg(F.max_by(F.element_at("args", 3), "seq").alias("v"))


def get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """keys' k with its value, null where there is none."""
    return keys.select("k").join(state(log), "k", "left")


def replies(log: DataFrame) -> DataFrame:
    """(seq, reply): what each command is answered, in the wire format. All connections share one state, in order of seq."""
    c = _command(log).where("n > 0")
    key = F.when(F.col("cmd").isin("SET", "GET"), F.try_element_at("args", F.lit(2)))
    value = F.when((F.col("cmd") == "SET") & (F.col("n") == 3), F.try_element_at("args", F.lit(3)))
    w = Window.partitionBy("_k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # commands without a key need no order: they are answered as they are and dealt out by their own number
    held = c.withColumn("_k", F.coalesce(key, F.concat(F.lit("\u0000"), F.col("seq").cast("string")))).withColumn("_old", F.last(value, ignorenulls=True).over(w))
    wrong = F.concat(F.lit("-ERR wrong number of arguments for '"), F.lower("cmd"), F.lit("' command\r\n"))
    reply = (
        F.when(F.col("cmd") == "PING", "+PONG\r\n")
        .when((F.col("cmd") == "SET") & (F.col("n") == 3), "+OK\r\n")
        .when((F.col("cmd") == "GET") & (F.col("n") == 2), F.coalesce(F.concat(F.lit("$"), F.octet_length("_old").cast("string"), F.lit("\r\n"), F.col("_old"), F.lit("\r\n")), F.lit("$-1\r\n")))
        .when(F.col("cmd") != "", wrong)
        .otherwise(F.concat(F.lit("-ERR unknown command '"), F.try_element_at("args", F.lit(1)), F.lit("'\r\n")))
    )
    return held.select("seq", reply.alias("reply"))

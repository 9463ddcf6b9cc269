"""The library's user functions under SQL names: register(spark), then `SELECT ... FROM t, LATERAL line_tokens(t.text)`."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ..model import DEFAULT_COLOUR
from .align import line_distance_udf, word_distance_udf


class LineTokens:
    """line_tokens(text [, separator]): a row per token, (word_idx, token, start), start in characters; empty tokens too. None of a null text."""

    @staticmethod
    def analyze(text: AnalyzeArgument, separator: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError(f"line_tokens: the text is a string, not {text.dataType.simpleString()}")
        if separator is not None and (not separator.isConstantExpression or not separator.value):
            raise ValueError("line_tokens: the separator is a constant of a character or more")
        return AnalyzeResult(StructType().add("word_idx", IntegerType()).add("token", StringType()).add("start", IntegerType()))

    def eval(self, text: str | None, separator: str = " ") -> Iterator[tuple]:
        at = 0
        for i, token in enumerate([] if text is None else text.split(separator)):
            yield i, token, at
            at += len(token) + len(separator)


class ChangeLog:
    """change_log(TABLE(words), session, time, ids, color [, default]): the log of grouped changes, (session, time, gid, color, former).

    The names are constants. Its own plan deals the table by session and orders it by time; a session's state is the colour of its ids.
    """

    @staticmethod
    def analyze(words: AnalyzeArgument, session: AnalyzeArgument, time: AnalyzeArgument, ids: AnalyzeArgument, color: AnalyzeArgument, default: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not words.isTable:
            raise ValueError("change_log: the first argument is TABLE(...)")
        types = {f.name: f.dataType for f in words.dataType.fields}
        names = [a.value for a in (session, time, ids, color)]
        missing = [n for n in names if n not in types]
        if missing:
            raise ValueError(f"change_log: no column {', '.join(map(repr, missing))}")
        if not isinstance(types[names[2]], ArrayType):
            raise ValueError(f"change_log: {names[2]} is an array of ids")
        out = StructType().add(names[0], types[names[0]]).add(names[1], types[names[1]]).add("gid", IntegerType()).add("color", StringType()).add("former", StringType())
        return AnalyzeResult(out, partitionBy=[PartitioningColumn(names[0])], orderBy=[OrderingColumn(names[1])], select=[SelectedColumn(n) for n in names])

    def __init__(self) -> None:
        self.state: dict[int, str] = {}

    def eval(self, row: Row, session: str, time: str, ids: str, color: str, default: str = DEFAULT_COLOUR) -> Iterator[tuple]:
        now, group = row[color], [int(g) for g in row[ids] or () if g != -1]
        former = [self.state.get(g, default) for g in group]
        if now is None or not group or now in former:
            return
        self.state.update(dict.fromkeys(group, now))
        for g, before in zip(group, former, strict=True):
            yield row[session], row[time], g, now, before


def register(spark: SparkSession) -> None:
    """line_tokens, change_log, line_distance(ocr, line) and word_distance(ocr, word)."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("line_tokens", udtf(LineTokens))
    spark.udtf.register("change_log", udtf(ChangeLog))
    spark.udf.register("line_distance", line_distance_udf)
    spark.udf.register("word_distance", word_distance_udf)

"""Delimited text as all-string tables."""

from __future__ import annotations

import csv
import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Delimiters in order of preference, and the two encodings that can be chosen.
DELIMITERS = (",", ";", "\t", "|")
UTF8, LATIN1 = "UTF-8", "ISO-8859-1"
# End of fixed values.


@dataclass(frozen=True)
class TextFormat:
    encoding: str = UTF8
    delimiter: str = ","
    header: bool = True
    columns: tuple[str, ...] = ()


def pick_delimiter(line: str) -> str:
    """Most frequent delimiter of a line, the earlier one on a tie."""
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))


def sniff_format(spark: SparkSession, path: str) -> TextFormat:
    """Encoding, delimiter, header and column names of a text file.

    One distributed pass checks that every line is UTF-8 (a file that is not is read as
    Latin-1, which accepts any bytes); only the first non-blank line reaches the driver.
    """
    lines = spark.read.text(path)
    valid = lines.agg(F.bool_and(F.is_valid_utf8("value")).alias("ok")).first()["ok"]
    encoding = LATIN1 if valid is False else UTF8
    # text is read as raw bytes, so the cast restores them whatever the encoding
    first = lines.where(F.trim("value") != "").select(F.col("value").cast("binary").alias("b")).first()
    if first is None:
        return TextFormat(encoding)
    text = bytes(first["b"]).decode("utf-8" if encoding == UTF8 else "latin-1").lstrip("﻿")
    delimiter = pick_delimiter(text)
    names = tuple(n.strip().strip('"') for n in next(csv.reader([text], delimiter=delimiter)))
    return TextFormat(encoding, delimiter, text.startswith('"') or delimiter in text, names)


LINE = "_line"
MARK = "\u0002"


def quoted(name: str) -> str:
    return "`{}`".format(name.replace("`", "``"))


def surplus_line(names: Sequence[str], delimiter: str) -> Column:
    """The line of a row with more fields than `names`, NULL for others; of a row with fewer nothing is lost.

    Spark keeps the text of rows whose number of fields is not the schema's. With a mark as one
    more field they are parsed again: a row of too many fields has it beyond the first that follow
    the names, whether its own further fields are empty or not.
    """
    wider = ", ".join(f"f{i} string" for i in range(len(names) + 1))
    fields = F.from_csv(F.concat(F.col(LINE), F.lit(delimiter + MARK)), F.lit(wider), {"sep": delimiter, "quote": '"', "escape": '"'})
    marked = F.exists(F.array(*[fields[f"f{i}"] for i in range(len(names) + 1)]), lambda x: x.eqNullSafe(F.lit(MARK)))
    return F.when(F.col(LINE).isNotNull(), F.when(~marked, F.col(LINE)))


def read_delimited(spark: SparkSession, path: str, fmt: TextFormat | None = None,
                   label: str | None = None, multi_line: bool = False, surplus: str = "fail") -> DataFrame:
    """Every column as text without enclosing quotes, plus _source_file and _ingested_at.

    Columns of a file without a header are called column0, column1, ... Set `multi_line` for quoted
    values with line breaks; such files cannot be split. A row with more fields than there are
    columns ends the job with its text, or (`surplus` = "keep") has it in a further column
    _surplus. Fields that a row lacks are NULL.
    """
    if surplus not in ("fail", "keep"):
        raise ValueError(f"surplus must be fail or keep, not {surplus}")
    fmt = fmt or sniff_format(spark, path)
    names = fmt.columns or sniff_format(spark, path).columns
    if not names:
        raise ValueError(f"no columns found in {path}")
    if not fmt.header:
        names = tuple(f"column{i}" for i in range(len(names)))
    schema = ", ".join(f"{quoted(n)} string" for n in (*names, LINE))
    raw = spark.read.csv(path, schema=schema, sep=fmt.delimiter, header=fmt.header,
                         encoding=fmt.encoding, quote='"', escape='"', multiLine=multi_line,
                         enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord=LINE)
    clean = [F.expr(f"trim(BOTH '\"' FROM {quoted(n)})").alias(n) for n in names]
    more = surplus_line(names, fmt.delimiter)
    # the check stands in a column that every use of the table reads
    source = F.lit(label or os.path.basename(path))
    if surplus == "fail":
        source = F.when(more.isNotNull(), F.raise_error(F.concat(
            F.lit(f"{path} has a row of more than {len(names)} fields: "), more))).otherwise(source)
    marked = [more.alias("_surplus")] if surplus == "keep" else []
    return raw.select(*clean, source.alias("_source_file"), F.current_timestamp().alias("_ingested_at"), *marked)

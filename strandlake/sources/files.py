"""File sources: delimited text, JSON, logs, SDF, mmCIF, arrays and spreadsheets."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import require_columns

#: Characters that a separator is guessed from.
SEPARATORS = ",\t;|"


def strings(*names: str) -> T.StructType:
    """A schema of string columns."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = True, columns: Sequence[str] | None = None, multi_line: bool = False) -> DataFrame:
    """Delimited text with a schema of its own, never an inferred one; ``columns`` prunes.

    With a header, columns are found by name; ``multi_line`` reads quoted line breaks, at the cost of
    splitting files.
    """
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("quote", '"').option("escape", '"').option("multiLine", multi_line).option("enforceSchema", not header)
    df = reader.csv(path)
    return df.select(*columns) if columns else df


def read_indexed_csv(spark: SparkSession, path: str, schema: T.StructType, index: str = "_c0", **options) -> DataFrame:
    """Delimited text whose first column is a row number, which is left out."""
    full = T.StructType([T.StructField(index, T.StringType()), *schema])
    return spark.read.schema(full).option("header", True).option("enforceSchema", True).options(**options).csv(path).drop(index)


def read_tsv(spark: SparkSession, path: str, names: Sequence[str], header: bool = True) -> DataFrame:
    """Tab-separated text, all strings; headerless files get the names."""
    return read_csv(spark, path, strings(*names), sep="\t", header=header)


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a file or of some file of a folder."""
    row = spark.read.text(path).first()
    return row[0] if row else ""


def read_sniffed(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """Delimited text with a header, all strings; the separator is the most frequent candidate in the header."""
    head = first_line(spark, path)
    sep = max(SEPARATORS, key=lambda s: (head.count(s), -SEPARATORS.index(s)))
    names = next(iter(pd.read_csv(io.StringIO(head), sep=sep, header=None, dtype=str, chunksize=1))).iloc[0].tolist()
    return require_columns(read_csv(spark, path, strings(*[str(n) for n in names]), sep=sep), required)


def with_ordinal(df: DataFrame, name: str = "src_ord") -> DataFrame:
    """Rows of file sources with a number that grows in file order.

    It follows file name, then place in the file, as far as the files are read by one split each or
    in order; it is made at the scan, before any shuffle.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def read_json_list(spark: SparkSession, path: str, name: str = "entity_id") -> DataFrame:
    """A JSON list of strings in one file as rows (idx, name)."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("idx", name)).withColumn("idx", F.col("idx").cast("long"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text with the file they are from."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def read_epochs(spark: SparkSession, pattern: str) -> DataFrame:
    """Text files below ``epoch_N`` folders, with N as a number to sort by."""
    return read_log(spark, pattern).withColumn("epoch", F.regexp_extract("file", r"epoch_(\d+)", 1).try_cast("int"))


def read_sdf(spark: SparkSession, path: str, properties: Sequence[str], smiles: str | None = None) -> DataFrame:
    """Records of an SDF file: ``molblock`` and the properties asked for, null where missing.

    Records are split at the lines that begin with the delimiter, whatever ends these lines, so
    large files are read in parallel. With ``smiles`` the molecules' canonical texts are a column
    of that name, and records without a readable molecule are left out.
    """
    rows = spark.read.option("lineSep", "\n$$$$").text(path)
    record = F.regexp_replace("value", r"\A\r?\n", "")  # what ended the delimiter's line

    def value(name: str):
        pattern = r"(?m)^>[^\n]*<" + re.escape(name) + r">[^\n]*\r?\n([^\n\r]*)"
        found = F.regexp_extract(record, pattern, 1)
        return F.when(record.rlike(pattern), found).alias(name)

    # the counts are in a block's fourth line, so an empty title of the first record can be told from the end of a delimiter's line
    exact = F.regexp_extract("value", r"(?s)\A(?:\r?\n)?((?:[^\n]*\n){3}[^\n]*V[23]000.*?M  END)", 1)
    block = F.when(exact != "", exact).otherwise(F.regexp_extract(record, r"(?s)\A(.*?M  END)", 1))
    found = rows.where(F.trim(F.translate("value", "\r\n", "")) != "").select(block.alias("molblock"), *[value(p) for p in properties])
    if smiles is None:
        return found
    from ..operators.molecules import block_canonical

    return found.withColumn(smiles, block_canonical(F.col("molblock"))).where(F.col(smiles).isNotNull())


def cif_tokens(text: str) -> Iterator[tuple[bool, str]]:
    """(is quoted, token) of an mmCIF text; text fields between lines of semicolons are one token."""
    held: list[str] | None = None
    for line in text.splitlines():
        if held is not None:
            if line.startswith(";"):
                yield True, "\n".join(held)
                held = None
            else:
                held.append(line)
            continue
        if line.startswith(";"):
            held = [line[1:]]
            continue
        for m in re.finditer(r"""'((?:[^']|'(?!\s|$))*)'(?=\s|$)|"((?:[^"]|"(?!\s|$))*)"(?=\s|$)|(\#.*)|(\S+)""", line):
            if m[3] is not None:
                break
            if m[4] is not None:
                yield False, m[4]
            else:
                yield True, m[1] if m[1] is not None else m[2]


def parse_cif(text: str) -> dict[str, list[str]]:
    """Data items of an mmCIF text as lists of values."""
    out: dict[str, list[str]] = {}
    names: list[str] = []
    state, at = "item", 0
    for quoted, token in cif_tokens(text):
        low = token.lower()
        if not quoted and low.startswith("data_"):
            state, names = "item", []
        elif not quoted and low == "loop_":
            state, names, at = "names", [], 0
        elif not quoted and token.startswith("_"):
            if state != "names":
                state, names = "item", [token]
            else:
                names.append(token)
            out.setdefault(token, [])
        elif names:
            if state == "names":
                state = "values"
            out[names[at % len(names)]].append(token)
            at = at + 1 if state == "values" else 0
    return out


def read_cif(spark: SparkSession, path: str, items: Sequence[str]) -> DataFrame:
    """mmCIF files as rows: ``file`` and an array of values for each item asked for (empty where missing)."""
    schema = T.StructType([T.StructField("file", T.StringType()), *[T.StructField(i, T.ArrayType(T.StringType())) for i in items]])
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [parse_cif(bytes(c).decode("utf-8", "replace")) for c in part["content"]]
            yield pd.DataFrame({"file": part["path"], **{i: [f.get(i, []) for f in found] for i in items}})

    return files.mapInPandas(parse, schema)


def read_npy(spark: SparkSession, vectors: str, dim: int, ids: str | None = None) -> DataFrame:
    """A two-dimensional .npy file as rows (idx, embedding), and with ids, a JSON list or an .npy file of strings, the same rows' ids.

    Ranges of rows are read by tasks of their own.
    """
    from .arrays import read_arrays

    rows = read_arrays(spark, vectors)
    shape = F.concat_ws(", ", F.transform("shape", lambda n: n.cast("string")))
    right = (F.size("shape") == 2) & (F.element_at("shape", 2) == dim)
    out = rows.select("idx", F.when(right, F.col("values").cast("array<float>")).otherwise(F.raise_error(F.concat(F.lit(f"vectors of {dim} numbers are expected, the file has the shape "), shape))).alias("embedding"))
    if ids is None:
        return out
    return out.join(read_arrays(spark, ids).select("idx", F.col("text").alias("id")) if ids.endswith(".npy") else read_json_list(spark, ids, "id"), "idx")


def read_excel(spark: SparkSession, path: str, schema: T.StructType, header: int = 0, sheet: int | str = 0) -> DataFrame:
    """Spreadsheets by pandas, where its spreadsheet library is installed; all values as strings."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                yield pd.read_excel(io.BytesIO(bytes(content)), header=header, sheet_name=sheet, dtype=str)[schema.names]

    return files.mapInPandas(load, schema)


def strand_sequences(monomers: DataFrame, file: str, strand: str, position: str, monomer: str) -> DataFrame:
    """Monomers of each strand joined in file order."""
    lists = monomers.groupBy(file, strand).agg(F.array_sort(F.collect_list(F.struct(position, monomer))).alias("_m"))
    return lists.select(file, strand, F.col(f"_m.{monomer}").alias("monomers"))


def last_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_p", place).where(F.col("_p") == 1).drop("_p")

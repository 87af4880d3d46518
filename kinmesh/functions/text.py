"""Columns that print values as Python's str() does, and serializers: how a row becomes text."""

from __future__ import annotations

import string
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _double_text(c: Column) -> Column:
    """A double as Python prints it: plain from 1e-4 up to 1e16, with an exponent elsewhere."""
    java, size = c.cast("string"), F.abs(c)
    plain = F.concat(F.rtrim(java.cast("decimal(38,20)").cast("string"), F.lit("0")), F.lit("0"))
    plain = F.regexp_replace(plain, r"(\.\d+)0$", "$1")
    mantissa = F.regexp_replace(F.regexp_extract(java, r"^(-?[\d.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(java, r"E(-?\d+)$", 1)
    sign = F.when(power.startswith("-"), "-").otherwise("+")
    digits = F.regexp_replace(power, "-", "")
    digits = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    scientific = F.concat(mantissa, F.lit("e"), sign, digits)
    plain_java = (size == 0) | ((size >= 1e-3) & (size < 1e7))
    text = F.when(plain_java, java).when((size >= 1e-4) & (size < 1e16), plain).otherwise(scientific)
    special = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
    return F.coalesce(special, text)


def py_text(c: Column, kind: T.DataType) -> Column:
    """str(value) of a cell; null prints as None."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = _double_text(c.cast("double"))
    elif isinstance(kind, T.BooleanType):
        text = F.when(c, "True").otherwise("False")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        text = F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    else:
        text = c.cast("string")
    return F.when(c.isNull(), "None").otherwise(text)


def id_text(df: DataFrame, name: str) -> Column:
    return py_text(F.col(f"`{name}`"), df.schema[name].dataType)


class Serializer:
    """How a row becomes text; subclasses give a column, so serializing needs no Python worker."""

    def to_column(self, df: DataFrame) -> Column:
        raise NotImplementedError


class WholeRowSerializer(Serializer):
    """All columns in order, the id included, with ' | ' between."""

    def to_column(self, df: DataFrame) -> Column:
        return F.concat_ws(" | ", *(id_text(df, c) for c in df.columns))


class FieldwiseSerializer(Serializer):
    """Listed columns in order; one that is not there is empty and keeps its separator."""

    def __init__(self, fields: Sequence[str], sep: str = " | "):
        self.fields, self.sep = list(fields), sep

    def to_column(self, df: DataFrame) -> Column:
        return F.concat_ws(self.sep, *(id_text(df, c) if c in df.columns else F.lit("") for c in self.fields))


class TemplateSerializer(Serializer):
    """A str.format template over the columns; column_mapping names a source column's variable."""

    def __init__(self, template: str, *, column_mapping: Mapping[str, str] | None = None):
        self.template, self.mapping = template, dict(column_mapping or {})

    def to_column(self, df: DataFrame) -> Column:
        variables = {c: c for c in df.columns} | {v: c for c, v in self.mapping.items() if c in df.columns}
        parts, plain = [], True
        for literal, name, spec, conversion in string.Formatter().parse(self.template):
            if literal:
                parts.append(F.lit(literal))
            if name is None:
                continue
            key = name.split(".")[0].split("[")[0]
            if key not in variables:
                raise KeyError(key)
            plain &= name == key and not spec and not conversion
            parts.append(id_text(df, variables[key]))
        if plain:
            return F.concat(*parts) if parts else F.lit("")
        return self._formatted(variables)

    def _formatted(self, variables: dict[str, str]) -> Column:
        """Format specifications and conversions need Python; whole Arrow batches go there."""
        template, names = self.template, list(variables)

        @F.pandas_udf("string")
        def render(rows):
            import pandas as pd

            return pd.Series([template.format_map(dict(zip(names, r))) for r in rows.itertuples(index=False, name=None)])

        return render(F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(variables.values()))))


class FunctionSerializer(Serializer):
    """A Python function of the row as a dict."""

    def __init__(self, function: Callable[[dict], str]):
        self.function = function

    def to_column(self, df: DataFrame) -> Column:
        function, names = self.function, df.columns

        @F.pandas_udf("string")
        def render(rows):
            import pandas as pd

            return pd.Series([function(dict(zip(names, r))) for r in rows.itertuples(index=False, name=None)])

        return render(F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names))))


def default_serializer() -> Serializer:
    return WholeRowSerializer()


def ngrams(text: Column, n: int = 3) -> Column:
    """The lowered text's character n-grams, repeats included; a shorter text is one gram, a blank one has none."""
    blank = F.array().cast("array<string>")
    # the array of characters is bound once, outside the inner lambda
    bound = F.transform(F.array(F.split(F.lower(text), "")), lambda c: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(c, i, n), "")
    ))
    return F.when(text.rlike(r"(?U)\S"), F.get(bound, 0)).otherwise(blank)


def ngram_buckets(text: Column, n_features: int = 256, n: int = 3) -> Column:
    """The n-grams' buckets: crc32 of their UTF-8 bytes, modulo the number of features."""
    return F.transform(ngrams(text, n), lambda g: F.pmod(F.crc32(F.encode(g, "UTF-8")), F.lit(n_features)).cast("int"))


def tokens(text: Column) -> Column:
    """The distinct lowered words between blanks."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"(?U)\s+"), ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; null where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)

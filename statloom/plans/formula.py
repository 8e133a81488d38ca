"""Formulas: ``y ~ x1 + C(g) + a:b + a*b + log(x) + offset(e) - 1`` to a projection.

A formula becomes one lazy ``select`` of double columns; only the levels of categorical
columns need a (distinct) job, and they are kept with the design so that scoring a new
frame uses the training levels.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.plans.order import dense_ids


class StatError(ValueError):
    """Base of the library's errors."""


class InvalidInput(StatError):
    pass


class InsufficientData(StatError):
    def __init__(self, needed: int, got: int):
        super().__init__(f"insufficient data: needed {needed}, got {got}")


class SingularMatrix(StatError):
    pass


_CALL = re.compile(r"^(\w+)\(\s*([\w.]+)\s*\)$")
_NAME = re.compile(r"^[A-Za-z_][\w.]*$")
_TRANSFORMS = ("log", "sqrt", "exp")


@dataclass(frozen=True)
class Term:
    """kind: numeric, categorical, interaction, log, sqrt, exp or offset."""

    kind: str
    columns: tuple[str, ...]

    @property
    def name(self) -> str:
        if self.kind == "numeric":
            return self.columns[0]
        if self.kind == "interaction":
            return ":".join(self.columns)
        return f"{'C' if self.kind == 'categorical' else self.kind}({self.columns[0]})"


@dataclass(frozen=True)
class Formula:
    response: str
    terms: tuple[Term, ...]
    intercept: bool = True

    @staticmethod
    def parse(text: str) -> Formula:
        left, tilde, right = text.partition("~")
        response = left.strip()
        if not tilde or not _NAME.match(response):
            raise InvalidInput(f"a formula reads 'y ~ x1 + x2': {text!r}")
        terms: list[Term] = []
        intercept, plain_zero = True, False
        for sign, piece in re.findall(r"([+-]?)\s*([^+-]+)", right):
            piece = piece.strip()
            if sign == "-":
                if piece not in ("1", "0"):
                    raise InvalidInput(f"only the intercept can be taken away: -{piece}")
                intercept = False
            elif piece == "0":
                intercept, plain_zero = False, True
            elif piece != "1":
                terms += [t for t in _terms(piece) if t not in terms]
        if not terms and not plain_zero:
            raise InvalidInput("a formula needs a predictor")
        return Formula(response, tuple(dict.fromkeys(terms)), intercept)

    def predictor_names(self) -> list[str]:
        return [t.name for t in self.terms if t.kind != "offset"]


def _terms(piece: str) -> list[Term]:
    if "*" in piece:
        parts = [p.strip() for p in piece.split("*")]
        if len(parts) != 2 or not all(_NAME.match(p) for p in parts):
            raise InvalidInput(f"a * b crosses two numeric columns: {piece}")
        return [Term("numeric", (p,)) for p in parts] + [Term("interaction", tuple(parts))]
    if ":" in piece:
        parts = tuple(p.strip() for p in piece.split(":"))
        if len(parts) < 2 or not all(_NAME.match(p) for p in parts):
            raise InvalidInput(f"a:b takes numeric columns: {piece}")
        return [Term("interaction", parts)]
    call = _CALL.match(piece)
    if call:
        name, column = call.groups()
        kind = "categorical" if name == "C" else name
        if kind not in ("categorical", "offset", *_TRANSFORMS):
            raise InvalidInput(f"unknown function {name}")
        return [Term(kind, (column,))]
    if not _NAME.match(piece):
        raise InvalidInput(f"not a term: {piece!r}")
    return [Term("numeric", (piece,))]


@dataclass
class Design:
    """A lazy frame with a response ``y``, predictors ``x0..``, and, where asked for, an
    ``offset``, a ``weight``, a ``grp`` and an ``ord`` column; ``names`` are the predictors'."""

    df: DataFrame
    names: list[str]
    intercept: bool = True
    formula: Formula | None = None
    levels: dict[str, list] = field(default_factory=dict)
    has_offset: bool = False
    #: Predictors as expressions of a raw frame, for designs without a formula whose names
    #: are no columns.
    made: tuple[Column, ...] = ()

    def rows(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        """``df`` with predictor columns for scoring, by the training levels; and those
        columns, the constant not among them."""
        if self.formula is None:
            own = self.made or tuple(F.col(f"`{n}`").cast("double") for n in self.names)
            out = df.withColumns({f"__x{k}": c for k, c in enumerate(own)})
        else:
            # the projection's columns, computed beside the frame's own
            packed = df.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in df.columns]))
            packed = design(packed, self.formula, extra={"__row": "__row"}, levels=self.levels, response=False).df
            out = packed.select("__row.*", *[F.col(f"x{k}").alias(f"__x{k}") for k in range(len(self.names))], *([F.col("offset").alias("__offset")] if self.has_offset else []))
        return out, [F.col(f"__x{k}") for k in range(len(self.names))]

    @property
    def k(self) -> int:
        return len(self.names) + self.intercept

    @property
    def coef_names(self) -> list[str]:
        return ["const", *self.names] if self.intercept else list(self.names)

    def x(self) -> list[Column]:
        """Columns of the design matrix, the constant first."""
        own = [F.col(f"x{k}") for k in range(len(self.names))]
        return [F.lit(1.0), *own] if self.intercept else own

    def linear(self, beta) -> Column:
        """The linear predictor without an offset."""
        total = F.lit(0.0)
        for b, x in zip(beta, self.x(), strict=True):
            total = total + F.lit(float(b)) * x
        return total

    def with_df(self, df: DataFrame) -> Design:
        return replace(self, df=df)


def _number(df: DataFrame, name: str) -> Column:
    kinds = dict(df.dtypes)
    if name not in kinds:
        raise InvalidInput(f"unknown column {name!r}")
    if kinds[name] == "string":
        raise InvalidInput(f"column {name!r} is categorical; write C({name})")
    return F.col(f"`{name}`").cast("double")


def _checked(func: str, name: str, x: Column) -> Column:
    if func == "exp":
        return F.exp(x)
    bad = x <= 0 if func == "log" else x < 0
    return F.when(bad, F.raise_error(F.lit(f"{func}({name}) of a value out of its domain")).cast("double")).otherwise(getattr(F, func)(x))


def levels_of(df: DataFrame, column: str, limit: int = 10_000) -> list:
    """Sorted distinct values; a design with more than ``limit`` of them is refused."""
    rows = df.select(F.col(f"`{column}`").alias("v")).filter("v is not null").distinct().orderBy("v").limit(limit + 1).collect()
    if len(rows) > limit:
        raise InvalidInput(f"column {column!r} has more than {limit} levels")
    return [r["v"] for r in rows]


def design(df: DataFrame, formula: str | Formula, extra: dict[str, str] | None = None, levels: dict[str, list] | None = None, categorical: tuple[str, ...] = (), response: bool = True) -> Design:
    """Project ``df`` onto a formula. ``extra`` maps names (weight, grp, ord, ...) to
    columns that go along. The first level of a categorical column is the base."""
    f = Formula.parse(formula) if isinstance(formula, str) else formula
    found = dict(levels or {})
    out: list[Column] = []
    names: list[str] = []
    offset: Column | None = None
    for term in f.terms:
        kind = "categorical" if term.kind == "numeric" and term.columns[0] in categorical else term.kind
        column = term.columns[0]
        if kind == "categorical":
            if column not in df.columns:
                raise InvalidInput(f"unknown column {column!r}")
            own = found.setdefault(column, levels_of(df, column) if column not in found else found[column])
            for level in own[1:]:
                out.append((F.col(f"`{column}`") == F.lit(level)).cast("double"))
                names.append(f"{column}[T.{level:g}]" if isinstance(level, float) else f"{column}[T.{level}]")
        elif kind == "interaction":
            product = F.lit(1.0)
            for c in term.columns:
                product = product * _number(df, c)
            out.append(product)
            names.append(term.name)
        elif kind == "offset":
            offset = _number(df, column)
        elif kind in _TRANSFORMS:
            out.append(_checked(kind, column, _number(df, column)))
            names.append(term.name)
        else:
            out.append(_number(df, column))
            names.append(term.name)
    columns = [_number(df, f.response).alias("y")] if response else []
    columns += [c.alias(f"x{k}") for k, c in enumerate(out)]
    if offset is not None:
        columns.append(offset.alias("offset"))
    columns += [F.col(f"`{c}`").alias(name) for name, c in (extra or {}).items()]
    return Design(df.select(*columns), names, f.intercept, f, found, offset is not None)


def from_columns(df: DataFrame, y: str, x: list[str], intercept: bool = True, extra: dict[str, str] | None = None) -> Design:
    """A design from plain column names."""
    columns = [_number(df, y).alias("y"), *[_number(df, c).alias(f"x{k}") for k, c in enumerate(x)]]
    columns += [F.col(f"`{c}`").alias(name) for name, c in (extra or {}).items()]
    return Design(df.select(*columns), list(x), intercept)


def drop_missing(df: DataFrame) -> DataFrame:
    """Rows without a null or NaN in any numeric column."""
    keep = F.lit(True)
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            keep = keep & F.col(f"`{name}`").isNotNull() & ~F.isnan(F.col(f"`{name}`"))
        elif kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
            keep = keep & F.col(f"`{name}`").isNotNull()
    return df.filter(keep)


def group_ids(df: DataFrame, column: str, name: str = "group_id") -> DataFrame:
    """``df`` with dense ids of a column's sorted values; the distinct values are ranked
    and joined back, so no window runs over all rows."""
    ranked = dense_ids(df.select(F.col(f"`{column}`").alias("__v")).distinct(), "__v", name)
    return df.join(ranked, F.col(f"`{column}`").eqNullSafe(F.col("__v"))).drop("__v")

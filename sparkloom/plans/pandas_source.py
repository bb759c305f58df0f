"""Pandas and NumPy source code compiled to lazy DataFrames.

The source is parsed, never executed: each statement is interpreted in its order over DataFrames, and
what has no rule is an error with its line. Row order follows a hidden position taken when a table is
read, or the last sort.
"""

from __future__ import annotations

import ast
import inspect
import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.errors import FormulaError, UnsupportedError
from sparkloom.functions import modes
from sparkloom.functions.formula import compile_formula, quoted
from sparkloom.operators import joins, relational
from sparkloom.plans import sklearn_source
from sparkloom.sources import io

POS = "__pos"


@dataclass(frozen=True)
class Frame:
    """A table and the columns its rows are in order of."""

    df: DataFrame
    order: tuple = (POS,)
    index: tuple = ()

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != POS]

    def sorted(self) -> list[Column]:
        return [c if isinstance(c, Column) else F.col(c) for c in self.order if not isinstance(c, str) or c in self.df.columns] or [F.lit(0)]


@dataclass(frozen=True)
class Series:
    """A column of a frame."""

    frame: Frame
    col: Column
    name: str


@dataclass(frozen=True)
class Filled(Series):
    """A series that needs a column of its own frame; assigning it takes this frame."""


@dataclass(frozen=True)
class Grouped:
    frame: Frame
    keys: list[str]
    column: str | None = None


@dataclass(frozen=True)
class Rolling:
    frame: Frame
    keys: list[str]
    col: Column
    name: str
    size: int | None
    min_periods: int | None = None


@dataclass(frozen=True)
class Accessor:
    series: Series
    kind: str


@dataclass
class Module:
    name: str
    calls: dict = field(default_factory=dict)


AGGREGATES = {"sum": "SUM", "mean": "AVG", "average": "AVG", "avg": "AVG", "count": "COUNT", "size": "SIZE", "min": "MIN", "max": "MAX", "first": "FIRST", "last": "LAST", "std": "STDDEV", "var": "VAR", "median": "MEDIAN", "nunique": "COUNTD", "prod": "PRODUCT", "list": "COLLECT_LIST"}
CASTS = {"int": "bigint", "int64": "bigint", "int32": "int", "float": "double", "float64": "double", "str": "string", "string": "string", "object": "string", "bool": "boolean", "boolean": "boolean", "datetime64[ns]": "timestamp_ntz", "category": "string"}


class _Returned(Exception):
    """The value that a function of the program returns."""

    def __init__(self, value: Any) -> None:
        super().__init__()
        self.value = value


#: Arguments that change nothing here, with the values for which that is so; None: any value.
HARMLESS: dict[str, tuple | None] = {
    "inplace": (False,), "copy": None, "ignore_index": None, "axis": (0, "index"), "sort": None, "as_index": None, "observed": None, "group_keys": None, "kind": None, "na_position": ("last",), "verify_integrity": (False,), "validate": (None,), "indicator": (False,), "margins": (False,), "dropna": (True,),
    "left_index": (False,), "right_index": (False,), "center": (False,), "win_type": (None,), "limit": (None,), "engine": None, "numeric_only": None, "skipna": (True,), "na": (False,), "errors": ("coerce", "raise"), "drop": None, "percentiles": (None,), "include": (None,), "index": (False,), "replace": (False,),
}


def checked(f: Any, kw: dict) -> dict:
    """Arguments that ``f`` knows; others must be harmless, so that none is dropped unseen."""
    known = inspect.signature(f).parameters
    if any(p.kind is p.VAR_KEYWORD for p in known.values()):
        return kw
    for k in set(kw) - set(known):
        if k not in HARMLESS or HARMLESS[k] is not None and kw[k] not in HARMLESS[k]:
            raise UnsupportedError(f"argument {k}={kw[k]!r}")
    return {k: v for k, v in kw.items() if k in known}


#: Methods that plugins have added: name -> (compiler, base, args, kw) -> value.
METHODS: dict[str, Any] = {}


class Compiler:
    """One run over a module's statements. ``inputs`` maps a path or table name to a DataFrame."""

    def __init__(self, inputs: dict[str, DataFrame]) -> None:
        self.inputs = inputs
        self.env: dict[str, Any] = {}
        self.outputs: dict[str, Frame] = {}
        self.warnings: list[str] = []
        self.depth = 0

    def run(self, code: str) -> dict[str, DataFrame]:
        """All frames by variable, without the hidden position."""
        for s in ast.parse(code).body:
            try:
                self.statement(s)
            except (UnsupportedError, FormulaError) as e:
                raise UnsupportedError(f"line {s.lineno}: {e}") from e
        return {k: self.public(v) for k, v in self.env.items() if isinstance(v, (Frame, Series))}

    @staticmethod
    def public(v: Frame | Series) -> DataFrame:
        return v.df.drop(POS) if isinstance(v, Frame) else v.frame.df.select(v.col.alias(v.name))

    # --- statements ---

    def statement(self, s: ast.stmt) -> None:
        if isinstance(s, (ast.Import, ast.ImportFrom)):
            for a in s.names:
                base = s.module if isinstance(s, ast.ImportFrom) else a.name
                self.env[a.asname or a.name.split(".")[0]] = Module(a.name.split(".")[0] if isinstance(s, ast.Import) else f"{base}.{a.name}")
        elif isinstance(s, ast.Assign) and len(s.targets) == 1:
            self.assign(s.targets[0], self.value(s.value))
        elif isinstance(s, ast.AugAssign):
            self.assign(s.target, self.value(ast.BinOp(left=s.target, op=s.op, right=s.value)))
        elif isinstance(s, ast.Expr):
            if isinstance(s.value, ast.Constant) or isinstance(s.value, ast.Call) and isinstance(s.value.func, ast.Name) and s.value.func.id == "print":
                return
            self.value(s.value)
        elif isinstance(s, (ast.Pass, ast.Global)):
            return
        elif isinstance(s, ast.If):
            test = self.value(s.test)
            if isinstance(test, (Frame, Series, Grouped)):
                raise UnsupportedError("a branch on data")
            self.block(s.body if test else s.orelse)
        elif isinstance(s, ast.For) and not s.orelse:
            items = self.value(s.iter)
            if not isinstance(items, (list, tuple, range)):
                raise UnsupportedError("a loop over anything but a list")
            for item in items:
                self.assign(s.target, item)
                self.block(s.body)
        elif isinstance(s, ast.FunctionDef) and not s.decorator_list:
            self.env[s.name] = s
        elif isinstance(s, ast.Return):
            raise _Returned(self.value(s.value) if s.value else None)
        else:
            raise UnsupportedError(f"statement {type(s).__name__}")

    def block(self, body: list[ast.stmt]) -> None:
        for s in body:
            self.statement(s)

    def inline(self, f: ast.FunctionDef | ast.Lambda, args: list, kw: dict) -> Any:
        """A call of a function of the program: its body over its own names."""
        names = [a.arg for a in f.args.args]
        if f.args.vararg or f.args.kwarg or f.args.kwonlyargs or len(args) > len(names) or set(kw) - set(names):
            raise UnsupportedError("arguments of this kind")
        first = len(names) - len(f.args.defaults)
        bound = {names[first + i]: self.value(d) for i, d in enumerate(f.args.defaults)} | dict(zip(names, args, strict=False)) | kw
        if set(names) - set(bound):
            raise UnsupportedError(f"missing arguments {sorted(set(names) - set(bound))}")
        outer, self.env, self.depth = self.env, {**self.env, **bound}, self.depth + 1
        if self.depth > 50:
            raise UnsupportedError("functions that call themselves")
        try:
            if isinstance(f, ast.Lambda):
                return self.value(f.body)
            self.block(f.body)
        except _Returned as r:
            return r.value
        finally:
            self.env, self.depth = outer, self.depth - 1
        return None

    def assign(self, target: ast.expr, v: Any) -> None:
        if isinstance(target, ast.Tuple):
            for t, x in zip(target.elts, v, strict=True):
                self.assign(t, x)
        elif isinstance(target, ast.Name):
            self.env[target.id] = v
        elif isinstance(target, ast.Subscript) and isinstance(target.value, ast.Name):
            frame = self.env[target.value.id]
            name = self.value(target.slice)
            if isinstance(v, Filled):
                theirs = v.frame.df
                wide = set(frame.df.columns) <= set(theirs.columns) and "prediction" not in theirs.columns
                frame = replace(frame, df=theirs if wide else frame.df.join(theirs.select(POS, "__line"), POS, "left"))
            made = frame.df.withColumn(name, self.column(v))
            self.env[target.value.id] = replace(frame, df=made.drop("__line"))
        elif isinstance(target, ast.Subscript) and isinstance(target.value, ast.Attribute) and target.value.attr == "loc":
            mask, name = (self.value(x) for x in target.slice.elts)
            var = target.value.value.id
            frame = self.env[var]
            old = F.col(quoted(name)) if name in frame.df.columns else F.lit(None)
            self.env[var] = replace(frame, df=frame.df.withColumn(name, F.when(F.coalesce(mask.col, F.lit(False)), self.column(v)).otherwise(old)))
        else:
            raise UnsupportedError("this assignment")

    @staticmethod
    def column(v: Any) -> Column:
        return v.col if isinstance(v, Series) else v if isinstance(v, Column) else F.lit(v)

    # --- expressions ---

    def value(self, e: ast.expr) -> Any:
        if isinstance(e, ast.Constant):
            return e.value
        if isinstance(e, ast.Name):
            if e.id in self.env:
                return self.env[e.id]
            if e.id in ("int", "float", "str", "bool"):
                return e.id
            raise UnsupportedError(f"unknown name {e.id!r}")
        if isinstance(e, (ast.List, ast.Tuple)):
            return [self.value(x) for x in e.elts]
        if isinstance(e, ast.Dict):
            return {self.value(k): self.value(v) for k, v in zip(e.keys, e.values, strict=True)}
        if isinstance(e, ast.Lambda):
            return e
        if isinstance(e, ast.JoinedStr):
            return "".join(str(v.value) if isinstance(v, ast.Constant) else str(self.value(v.value)) for v in e.values)
        if isinstance(e, ast.BoolOp):
            got = [self.value(v) for v in e.values]
            if any(isinstance(v, (Frame, Series)) for v in got):
                raise UnsupportedError("and / or of columns: use & and |")
            return all(got) if isinstance(e.op, ast.And) else any(got)
        if isinstance(e, ast.UnaryOp):
            v = self.value(e.operand)
            if not isinstance(v, Series):
                return -v if isinstance(e.op, ast.USub) else not v
            c = -v.col if isinstance(e.op, ast.USub) else ~F.coalesce(v.col, F.lit(False))
            return replace(v, col=c)
        if isinstance(e, ast.BinOp):
            return self.binary(e.op, self.value(e.left), self.value(e.right))
        if isinstance(e, ast.Compare) and len(e.ops) == 1:
            return self.compare(e.ops[0], self.value(e.left), self.value(e.comparators[0]))
        if isinstance(e, ast.Subscript):
            return self.subscript(self.value(e.value), e.slice)
        if isinstance(e, ast.Attribute):
            return self.attribute(self.value(e.value), e.attr)
        if isinstance(e, ast.Call):
            return self.call(e)
        raise UnsupportedError(f"expression {type(e).__name__}")

    def binary(self, op: ast.operator, a: Any, b: Any) -> Any:
        s = a if isinstance(a, Series) else b
        if not isinstance(s, Series):
            plain = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: a / b, ast.Mod: lambda: a % b, ast.Pow: lambda: a**b, ast.FloorDiv: lambda: a // b}
            if type(op) in plain and all(isinstance(x, (int, float, str, list)) for x in (a, b)):
                return plain[type(op)]()
            raise UnsupportedError("arithmetic on these values")
        x, y = self.column(a), self.column(b)
        text = isinstance(a, str) or isinstance(b, str) or isinstance(op, ast.Add) and "string" in (self.kind(a), self.kind(b))
        table = {
            ast.Add: lambda: F.concat(x.cast("string"), y.cast("string")) if text else x + y, ast.Sub: lambda: x - y, ast.Mult: lambda: x * y, ast.Div: lambda: F.try_divide(x.cast("double"), y.cast("double")), ast.FloorDiv: lambda: F.floor(F.try_divide(x.cast("double"), y.cast("double"))),
            ast.Mod: lambda: F.pmod(x, y), ast.Pow: lambda: F.pow(x, y), ast.BitAnd: lambda: F.coalesce(x, F.lit(False)) & F.coalesce(y, F.lit(False)), ast.BitOr: lambda: F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False)),
        }
        if type(op) not in table:
            raise UnsupportedError(f"operator {type(op).__name__}")
        return replace(s, col=table[type(op)]())

    @staticmethod
    def kind(v: Any) -> str:
        return dict(v.frame.df.dtypes).get(v.name, "") if isinstance(v, Series) else ""

    def compare(self, op: ast.cmpop, a: Any, b: Any) -> Any:
        s = a if isinstance(a, Series) else b
        if not isinstance(s, Series):
            plain = {ast.Eq: lambda: a == b, ast.NotEq: lambda: a != b, ast.Lt: lambda: a < b, ast.LtE: lambda: a <= b, ast.Gt: lambda: a > b, ast.GtE: lambda: a >= b, ast.In: lambda: a in b, ast.NotIn: lambda: a not in b, ast.Is: lambda: a is b, ast.IsNot: lambda: a is not b}
            return plain[type(op)]()
        x, y = self.column(a), self.column(b)
        table = {ast.Eq: lambda: x == y, ast.NotEq: lambda: ~x.eqNullSafe(y), ast.Lt: lambda: x < y, ast.LtE: lambda: x <= y, ast.Gt: lambda: x > y, ast.GtE: lambda: x >= y}
        if type(op) not in table:
            raise UnsupportedError(f"comparison {type(op).__name__}")
        return replace(s, col=F.coalesce(table[type(op)](), F.lit(False)))

    def subscript(self, base: Any, index: ast.expr) -> Any:
        if isinstance(base, Accessor) and base.kind == "loc":
            return self.subscript(base.series.frame, index)
        key = self.value(index)
        if isinstance(base, Frame):
            if isinstance(key, Series):
                return replace(base, df=base.df.where(F.coalesce(key.col, F.lit(False))))
            if isinstance(key, list):
                return replace(base, df=base.df.select(*[quoted(c) for c in key], *([POS] if POS in base.df.columns else [])))
            if key not in base.df.columns:
                raise UnsupportedError(f"no column {key!r}")
            return Series(base, F.col(quoted(key)), key)
        if isinstance(base, Grouped):
            return replace(base, column=key if isinstance(key, str) else key[0])
        if isinstance(base, Series) and isinstance(key, Series):
            return replace(base, frame=replace(base.frame, df=base.frame.df.where(key.col)))
        raise UnsupportedError("this subscript")

    def attribute(self, base: Any, name: str) -> Any:
        if isinstance(base, Module):
            return Module(f"{base.name}.{name}")
        if isinstance(base, Series) and name in ("str", "dt", "cat"):
            return Accessor(base, name)
        if isinstance(base, sklearn_source.Estimator) and isinstance(base.state, dict) and name in base.state:
            return base.state[name]
        if isinstance(base, Frame):
            if name == "loc":
                return Accessor(Series(base, F.lit(None), ""), "loc")
            if name in base.df.columns:
                return Series(base, F.col(quoted(name)), name)
        if isinstance(base, Accessor) and base.kind == "dt":
            return self.date_part(base.series, name)
        raise UnsupportedError(f"attribute {name!r}")

    def date_part(self, s: Series, name: str) -> Series:
        table = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter, "dayofweek": F.weekday, "weekday": F.weekday, "dayofyear": F.dayofyear, "date": F.to_date, "days": lambda c: F.extract(F.lit("DAY"), c)}
        if name not in table:
            raise UnsupportedError(f".dt.{name}")
        return replace(s, col=table[name](s.col))

    # --- calls ---

    def call(self, e: ast.Call) -> Any:
        if isinstance(e.func, ast.Attribute) and e.func.attr in ("pipe", "apply") and e.args:
            base, f = self.value(e.func.value), self.value(e.args[0])
            if isinstance(f, (ast.FunctionDef, ast.Lambda)) and isinstance(base, (Frame, Series)) and (e.func.attr == "pipe" or isinstance(base, Series)):
                return self.inline(f, [base, *[self.value(a) for a in e.args[1:]]], {k.arg: self.value(k.value) for k in e.keywords})
        args = [self.value(a) for a in e.args]
        kw = {k.arg: self.value(k.value) for k in e.keywords}
        if isinstance(e.func, ast.Attribute):
            base = self.value(e.func.value)
            if e.func.attr in METHODS and not isinstance(base, Module):
                return METHODS[e.func.attr](self, base, args, kw)
            if isinstance(base, Module):
                return self.module_call(f"{base.name}.{e.func.attr}", args, kw)
            for kind, methods in ((Frame, "frame"), (Series, "series"), (Grouped, "grouped"), (Rolling, "rolling"), (Accessor, "text")):
                if isinstance(base, kind):
                    f = getattr(self, f"{methods}_{e.func.attr}", None)
                    if f is None and kind is Series and hasattr(self, f"shared_{e.func.attr}"):
                        f = getattr(self, f"shared_{e.func.attr}")
                    if f is None and kind in (Grouped, Rolling) and e.func.attr in AGGREGATES:
                        return (self.grouped_one if kind is Grouped else self.rolling_one)(base, AGGREGATES[e.func.attr])
                    if f is None and kind is Grouped:
                        return self.grouped_window(base, e.func.attr, args, kw)
                    if f is None and kind is Accessor and base.kind == "dt":
                        return self.date_call(base.series, e.func.attr, args)
                    if f is None and kind is Series and e.func.attr in AGGREGATES:
                        return replace(base, frame=Frame(base.frame.df.agg(relational._agg_over(AGGREGATES[e.func.attr], base.col).alias(base.name)), ()), col=F.col(quoted(base.name)))
                    if f is None:
                        raise UnsupportedError(f"{kind.__name__}.{e.func.attr}")
                    return f(base, *args, **checked(f, kw))
            if isinstance(base, sklearn_source.Estimator):
                return sklearn_source.method(self, base, e.func.attr, args, kw)
        elif isinstance(e.func, ast.Name) and isinstance(self.env.get(e.func.id), (ast.FunctionDef, ast.Lambda)):
            return self.inline(self.env[e.func.id], args, kw)
        elif isinstance(e.func, ast.Name) and e.func.id in ("range", "list", "len") and all(isinstance(a, (int, list, range)) for a in args):
            return {"range": range, "list": list, "len": len}[e.func.id](*args)
        elif isinstance(e.func, ast.Name) and isinstance(self.env.get(e.func.id), Module):
            return self.module_call(self.env[e.func.id].name, args, kw)
        raise UnsupportedError("this call")

    def read(self, path: str) -> Frame:
        for key in (path, path.rsplit("/", 1)[-1], path.rsplit("/", 1)[-1].rsplit(".", 1)[0]):
            if key in self.inputs:
                df = self.inputs[key]
                return Frame(df if POS in df.columns else df.withColumn(POS, F.monotonically_increasing_id()))
        raise UnsupportedError(f"no input for {path!r}")

    def module_call(self, name: str, args: list, kw: dict) -> Any:
        f = name.split(".", 1)[1] if "." in name else name
        lib = name.split(".")[0]
        if lib == "pandas":
            if f in ("read_csv", "read_parquet", "read_json", "read_excel", "read_table"):
                return self.read(args[0])
            if f == "merge":
                return self.frame_merge(*args, **checked(self.frame_merge, kw))
            if f == "concat":
                return Frame(relational.stack([x.df for x in args[0]]), args[0][0].order)
            if f == "to_numeric":
                return replace(args[0], col=args[0].col.try_cast("double"))
            if f == "to_datetime":
                c = args[0].col
                fmt = kw.get("format")
                parsed = F.try_to_timestamp(c.cast("string"), F.lit(_java_format(fmt))) if fmt else c.try_cast("timestamp")
                return replace(args[0], col=parsed.cast("timestamp_ntz"))
            if f == "merge_asof":
                left, right = args[:2]
                on = kw.get("on")
                by = kw.get("by")
                lo, ro = kw.get("left_on") or on, kw.get("right_on") or on
                made = joins.as_of(left.df, right.df.drop(POS), lo, ro, [by] if isinstance(by, str) else by, kw.get("direction", "backward"))
                clash = set(left.columns) & set(right.columns)
                return Frame(made.withColumnsRenamed({f"{c}_right": c for c in right.columns if c not in clash}).drop(*[f"{c}_right" for c in [ro] if c in clash]), left.order)
            if f == "get_dummies":
                df = args[0].df
                for c in kw.get("columns") or []:
                    df = modes.encode(df, c, "ONE_HOT").drop(c)
                return replace(args[0], df=df)
            if f in ("cut", "qcut"):
                s, n = args[0], args[1] if len(args) > 1 else kw.get("bins") or kw.get("q")
                mode = "QUANTILE" if f == "qcut" else "CUSTOM_BOUNDARIES" if isinstance(n, list) else "EQUAL_WIDTH"
                return replace(s, col=_bin_expr(s, mode, n, kw.get("labels")))
        if lib == "numpy":
            return self.numpy(f, args, kw)
        if lib == "sklearn":
            return sklearn_source.create(self, name.rsplit(".", 1)[1], args, kw)
        raise UnsupportedError(f"{name}")

    def numpy(self, f: str, args: list, kw: dict) -> Any:
        s = next((a for a in args if isinstance(a, Series)), None)
        if f == "where":
            return replace(s, col=F.when(F.coalesce(args[0].col, F.lit(False)), self.column(args[1])).otherwise(self.column(args[2])))
        if f == "select":
            out = F.lit(kw.get("default", args[2] if len(args) > 2 else 0))
            for c, v in reversed(list(zip(args[0], args[1], strict=True))):
                out = F.when(F.coalesce(c.col, F.lit(False)), self.column(v)).otherwise(out)
            return replace(args[0][0], col=out)
        if f in ("concatenate", "vstack", "stack") and args and isinstance(args[0], list) and all(isinstance(x, (Frame, Series)) for x in args[0]) and kw.get("axis", 0) == 0:
            if all(isinstance(x, Frame) for x in args[0]):
                return Frame(relational.stack([x.df for x in args[0]]), args[0][0].order)
            name = args[0][0].name
            return Series(Frame(relational.stack([x.frame.df.select(x.col.alias(name)) for x in args[0]]), ()), F.col(quoted(name)), name)
        if s is None and f in ("arange", "linspace", "zeros", "ones", "full") and all(isinstance(a, (int, float)) for a in args):
            return _numbers(f, args)
        if s is None:
            raise UnsupportedError(f"numpy.{f} of plain values")
        if f == "sort":
            return Series(Frame(s.frame.df.select(s.col.alias(s.name)).orderBy(F.col(quoted(s.name)).asc_nulls_last()), (F.col(quoted(s.name)).asc_nulls_last(),)), F.col(quoted(s.name)), s.name)
        if f == "unique" and kw.get("return_counts"):
            counted = s.frame.df.groupBy(s.col.alias(s.name)).agg(F.count(F.lit(1)).alias("count"))
            return [Series(Frame(counted, (s.name,)), F.col(quoted(s.name)), s.name), Series(Frame(counted, (s.name,)), F.col("count"), "count")]
        table = {
            "log": F.ln, "log10": F.log10, "log2": F.log2, "log1p": F.log1p, "exp": F.exp, "expm1": F.expm1, "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)), "cbrt": F.cbrt, "square": lambda c: c * c, "abs": F.abs, "absolute": F.abs, "floor": F.floor, "ceil": F.ceil, "rint": F.rint,
            "trunc": lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)), "sin": F.sin, "cos": F.cos, "tan": F.tan, "isnan": lambda c: c.isNull() | F.isnan(c.cast("double")), "isfinite": lambda c: F.abs(c) < float("inf"), "isinf": lambda c: F.abs(c) == float("inf"), "nan_to_num": lambda c: F.nanvl(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0)), "sign": F.signum,
        }
        if f in table:
            return replace(s, col=table[f](s.col))
        if f in ("round", "around"):
            return replace(s, col=F.bround(s.col, int(args[1]) if len(args) > 1 else 0))
        if f == "power":
            return replace(s, col=F.pow(s.col, self.column(args[1])))
        if f == "clip":
            return replace(s, col=modes.clipped(s.col, *args[1:3]))
        if f == "digitize":
            out = F.lit(0)
            for i, b in enumerate(args[1], 1):
                out = F.when(s.col >= b, i).otherwise(out)
            return replace(s, col=F.when(s.col.isNotNull(), out))
        if f in ("cumsum", "cumprod"):
            return self.series_window(s, "RUNNING_SUM" if f == "cumsum" else "RUNNING_PRODUCT")
        if f == "diff":
            return self.series_window(s, "LAG_DIFF")
        if f in ("sum", "mean", "min", "max", "median", "std", "var", "nansum", "nanmean", "nanstd"):
            g = {"std": F.stddev_pop, "var": F.var_pop, "nanstd": F.stddev_pop, "sum": F.sum, "nansum": F.sum, "mean": F.avg, "nanmean": F.avg, "min": F.min, "max": F.max, "median": F.median}[f]
            return Series(Frame(s.frame.df.agg(g(s.col).alias(s.name)), ()), F.col(quoted(s.name)), s.name)
        if f in ("percentile", "quantile"):
            q = args[1] / 100 if f == "percentile" else args[1]
            return Series(Frame(s.frame.df.agg(F.percentile(s.col, F.lit(float(q))).alias(s.name)), ()), F.col(quoted(s.name)), s.name)
        if f == "unique":
            return Series(Frame(s.frame.df.select(s.col.alias(s.name)).distinct().orderBy(s.name), ()), F.col(quoted(s.name)), s.name)
        raise UnsupportedError(f"numpy.{f}")

    # --- what estimators make ---

    @staticmethod
    def filtered(t: Frame | Series, cond: Column) -> Frame | Series:
        """Rows of a table or column by a condition on the hidden position."""
        return replace(t, df=t.df.where(cond)) if isinstance(t, Frame) else replace(t, frame=replace(t.frame, df=t.frame.df.where(cond)))

    @staticmethod
    def columns_of(x: Frame, names: list[str]) -> Frame:
        return replace(x, df=x.df.select(POS, *[quoted(c) for c in names]))

    @staticmethod
    def columns(x: Frame, made: dict[str, Column], gone: list[str] | None = None) -> Frame:
        return replace(x, df=x.df.withColumns(made).drop(*(gone or [])))

    @staticmethod
    def table(df: DataFrame, like: Frame) -> Frame:
        return Frame(df, (POS,))

    @staticmethod
    def series(s: Series, col: Column) -> Series:
        return replace(s, col=col)

    @staticmethod
    def made(df: DataFrame, name: str, like: Frame) -> Series:
        return Filled(Frame(df.withColumn("__line", F.col(name)), (POS,)), F.col("__line"), name)

    # --- frames ---

    def frame_copy(self, f, deep=True):
        return f

    def frame_reset_index(self, f):
        """Index columns stay columns throughout, so that there is nothing to put back."""
        return f

    def frame_set_index(self, f, keys):
        return replace(f, index=tuple([keys] if isinstance(keys, str) else keys))

    def frame_drop(self, f, labels=None, columns=None, axis=0):
        if columns is None and axis not in (1, "columns"):
            raise UnsupportedError("drop of rows by label")
        gone = columns if columns is not None else labels
        return replace(f, df=f.df.drop(*([gone] if isinstance(gone, str) else gone)))

    def frame_rename(self, f, columns=None):
        return replace(f, df=f.df.withColumnsRenamed(columns))

    def frame_assign(self, f, **named):
        for name, v in named.items():
            if isinstance(v, ast.Lambda):
                outer, self.env = self.env, {**self.env, v.args.args[0].arg: f}
                v = self.value(v.body)
                self.env = outer
            f = replace(f, df=f.df.withColumn(name, self.column(v)))
        return f

    def frame_query(self, f, text):
        return replace(f, df=f.df.where(F.coalesce(compile_formula(text), F.lit(False))))

    def frame_astype(self, f, t):
        return replace(f, df=f.df.withColumns({c: F.col(quoted(c)).try_cast(CASTS[str(k)]) for c, k in t.items()}))

    def frame_fillna(self, f, value=None, method=None):
        if method is not None:
            return self.frame_ffill(f) if method in ("ffill", "pad") else self.frame_bfill(f)
        return replace(f, df=f.df.fillna(value))

    def _each(self, f, make, numeric: bool = False):
        """Every column of a frame through a function of a series, all at once."""
        wanted = [c for c, t in f.df.dtypes if c != POS and (not numeric or t in ("int", "bigint", "double", "float", "smallint"))]
        return replace(f, df=f.df.withColumns({c: make(Series(f, F.col(quoted(c)), c)).col for c in wanted}))

    def frame_ffill(self, f): return self._each(f, self.shared_ffill)  # noqa: E704
    def frame_bfill(self, f): return self._each(f, self.shared_bfill)  # noqa: E704
    def frame_interpolate(self, f, method="linear"): return self._chain(f, method)  # noqa: E704
    def frame_round(self, f, decimals=0): return self._each(f, lambda s: self.shared_round(s, decimals), numeric=True)  # noqa: E704
    def frame_abs(self, f): return self._each(f, self.shared_abs, numeric=True)  # noqa: E704

    def _chain(self, f, method):
        for c, t in f.df.dtypes:
            if c != POS and t in ("int", "bigint", "double", "float", "smallint"):
                made = self.shared_interpolate(Series(f, F.col(quoted(c)), c), method)
                f = replace(f, df=made.frame.df.withColumn(c, F.col("__line")).drop("__line"))
        return f

    def frame_info(self, f):
        """Name, type and number of values of each column."""
        parts = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("col_type"), F.count(F.col(quoted(c))).alias("n")) for c, t in f.df.dtypes if c != POS]
        return Frame(f.df.agg(F.array(*parts).alias("s")).select(F.inline("s")), ())

    def frame_dropna(self, f, subset=None, how="any", thresh=None):
        return replace(f, df=f.df.dropna(how=how, thresh=thresh, subset=[subset] if isinstance(subset, str) else subset or f.columns))

    def frame_drop_duplicates(self, f, subset=None, keep="first"):
        keys = [subset] if isinstance(subset, str) else subset or f.columns
        w = Window.partitionBy(*[F.col(quoted(c)) for c in keys])
        if keep is False:
            return replace(f, df=f.df.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n = 1").drop("_n"))
        order = f.sorted() if keep == "first" else [F.desc(c) if isinstance(c, str) else _flip(c) for c in f.order]
        return replace(f, df=f.df.withColumn("_n", F.row_number().over(w.orderBy(*order))).where("_n = 1").drop("_n"))

    def frame_merge(self, f, right, on=None, left_on=None, right_on=None, how="inner", suffixes=("_x", "_y")):
        on_l, on_r = ([x] if isinstance(x, str) else x for x in (on or left_on, on or right_on))
        if how == "cross":
            return Frame(joins.join(f.df, right.df.drop(POS), [], "CROSS", tuple(suffixes)), f.order)
        if on_l is None:
            on_l = on_r = [c for c in f.columns if c in right.columns]
        kinds = {"inner": "INNER", "left": "LEFT", "right": "RIGHT", "outer": "OUTER"}
        if how not in kinds:
            raise UnsupportedError(f"merge how={how!r}")
        keys = [{"left": a, "right": b} for a, b in zip(on_l, on_r, strict=True)]
        return Frame(joins.join(f.df, right.df.drop(POS), keys, kinds[how], tuple(suffixes), null_safe=True), f.order)

    def frame_join(self, f, right, on=None, how="left", lsuffix="", rsuffix=""):
        """A join on ``on``, or on the columns set as index, by name."""
        keys = [on] if isinstance(on, str) else on or list(f.index) or list(right.index)
        if not keys or right.index and len(right.index) != len(keys):
            raise UnsupportedError("a join by position: set an index or name columns")
        theirs = list(right.index) or keys
        renamed = replace(right, df=right.df.withColumnsRenamed(dict(zip(theirs, keys, strict=True))))
        return self.frame_merge(f, renamed, on=keys, how=how, suffixes=(lsuffix, rsuffix))

    def frame_groupby(self, f, keys):
        return Grouped(f, [keys] if isinstance(keys, str) else keys)

    def frame_sort_values(self, f, by, ascending=True):
        by = [by] if isinstance(by, str) else by
        up = [ascending] * len(by) if isinstance(ascending, bool) else ascending
        order = tuple(F.col(quoted(c)).asc_nulls_last() if u else F.col(quoted(c)).desc_nulls_last() for c, u in zip(by, up, strict=True))
        return Frame(f.df.orderBy(*order, *([POS] if POS in f.df.columns else [])), (*order, POS))

    def frame_head(self, f, n=5):
        return replace(f, df=f.df.orderBy(*f.sorted()).limit(n))

    def frame_tail(self, f, n=5):
        return replace(f, df=f.df.orderBy(*[_flip(c) if isinstance(c, Column) else F.desc(c) for c in f.order]).limit(n))

    def frame_nlargest(self, f, n, columns):
        return replace(f, df=f.df.orderBy(F.col(quoted(columns)).desc_nulls_last(), *f.sorted()).limit(n))

    def frame_nsmallest(self, f, n, columns):
        return replace(f, df=f.df.orderBy(F.col(quoted(columns)).asc_nulls_last(), *f.sorted()).limit(n))

    def frame_sample(self, f, n=None, frac=None, random_state=7):
        df = relational.sample(f.df, "RANDOM_FIXED_NB" if n else "RANDOM_FIXED_RATIO", n, frac, key=f.columns, seed=int(random_state or 7))
        return replace(f, df=df)

    def frame_pivot_table(self, f, values=None, index=None, columns=None, aggfunc="mean", fill_value=None):
        rows = [index] if isinstance(index, str) else index
        df = relational.pivot(f.df, rows, columns, [{"column": values, "type": AGGREGATES[aggfunc], "outputColumn": "\u0001"}], fill=fill_value)
        return Frame(df.withColumnsRenamed({c: c.removesuffix("_\u0001") for c in df.columns}), ())

    frame_pivot = frame_pivot_table

    def frame_melt(self, f, id_vars=None, value_vars=None, var_name="variable", value_name="value"):
        ids = [id_vars] if isinstance(id_vars, str) else id_vars or []
        vals = value_vars or [c for c in f.columns if c not in ids]
        return Frame(f.df.unpivot([quoted(c) for c in ids], [quoted(c) for c in vals], var_name, value_name), ())

    def frame_explode(self, f, column):
        return replace(f, df=f.df.withColumn(column, F.explode_outer(F.col(quoted(column)))))

    def frame_describe(self, f):
        numeric = [c for c, t in f.df.dtypes if c != POS and t in ("int", "bigint", "double", "float")]
        return Frame(relational.statistics(f.df, numeric), ())

    def frame_nunique(self, f):
        return Frame(f.df.agg(*[F.count_distinct(F.col(quoted(c))).alias(c) for c in f.columns]), ())

    def _sink(self, f, path=None, **options):
        """Named as an output; ``store`` writes it."""
        self.outputs[str(path)] = f
        return f

    frame_to_csv = frame_to_parquet = frame_to_json = frame_to_excel = frame_to_feather = frame_to_pickle = _sink

    # --- series ---

    def series_window(self, s: Series, kind: str, n: int | None = None, method: str = "min", keys: list[str] | None = None, order: list[Column] | None = None) -> Series:
        w = Window.partitionBy(*[F.col(quoted(k)) for k in keys or []]).orderBy(*(order or s.frame.sorted()))
        return replace(s, col=_over(s, kind, w, n, method))

    def shared_cumsum(self, s): return self.series_window(s, "RUNNING_SUM")  # noqa: E704
    def shared_cummin(self, s): return self.series_window(s, "RUNNING_MIN")  # noqa: E704
    def shared_cummax(self, s): return self.series_window(s, "RUNNING_MAX")  # noqa: E704
    def shared_cumprod(self, s): return self.series_window(s, "RUNNING_PRODUCT")  # noqa: E704
    def shared_diff(self, s, periods=1): return self.series_window(s, "LAG_DIFF", periods)  # noqa: E704
    def shared_pct_change(self, s, periods=1): return self.series_window(s, "PCT_CHANGE", periods)  # noqa: E704
    def shared_shift(self, s, periods=1): return self.series_window(s, "LAG" if periods >= 0 else "LEAD", abs(periods))  # noqa: E704

    def shared_rank(self, s, method="average", ascending=True):
        return self.series_window(s, "RANK", method=method, order=[s.col.asc_nulls_last() if ascending else s.col.desc_nulls_last()])

    def shared_rolling(self, s, window, min_periods=None):
        return Rolling(s.frame, [], s.col, s.name, window, window if min_periods is None else min_periods)

    def shared_expanding(self, s):
        return Rolling(s.frame, [], s.col, s.name, None)

    def shared_isin(self, s, values): return replace(s, col=F.coalesce(s.col.isin(values), F.lit(False)))  # noqa: E704
    def shared_between(self, s, a, b): return replace(s, col=F.coalesce(s.col.between(a, b), F.lit(False)))  # noqa: E704
    def shared_isna(self, s): return replace(s, col=s.col.isNull())  # noqa: E704
    def shared_notna(self, s): return replace(s, col=s.col.isNotNull())  # noqa: E704
    shared_isnull, shared_notnull = shared_isna, shared_notna
    def shared_fillna(self, s, v): return replace(s, col=F.coalesce(s.col, self.column(v)))  # noqa: E704
    def shared_abs(self, s): return replace(s, col=F.abs(s.col))  # noqa: E704
    def shared_round(self, s, n=0): return replace(s, col=F.bround(s.col, n))  # noqa: E704
    def shared_clip(self, s, lower=None, upper=None): return replace(s, col=modes.clipped(s.col, lower, upper))  # noqa: E704
    def shared_astype(self, s, t): return replace(s, col=s.col.try_cast(CASTS[str(t)]))  # noqa: E704
    def shared_where(self, s, cond, other=None): return replace(s, col=F.when(cond.col, s.col).otherwise(self.column(other)))  # noqa: E704
    def shared_mask(self, s, cond, other=None): return replace(s, col=F.when(cond.col, self.column(other)).otherwise(s.col))  # noqa: E704
    def shared_combine_first(self, s, other): return replace(s, col=F.coalesce(s.col, other.col))  # noqa: E704

    def shared_map(self, s, table):
        if not isinstance(table, dict):
            raise UnsupportedError("map of a function")
        return replace(s, col=F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), s.col))

    def shared_replace(self, s, table, value=None):
        table = table if isinstance(table, dict) else {table: value}
        out = s.col
        for k, v in reversed(table.items()):
            out = F.when(s.col == F.lit(k), F.lit(v)).otherwise(out)
        return replace(s, col=out)

    def shared_value_counts(self, s):
        return Frame(s.frame.df.where(s.col.isNotNull()).groupBy(s.col.alias(s.name)).agg(F.count(F.lit(1)).alias("count")), (F.desc("count"), s.name))

    def shared_ffill(self, s):
        w = Window.partitionBy().orderBy(*s.frame.sorted()).rowsBetween(Window.unboundedPreceding, 0)
        return replace(s, col=F.last(s.col, ignorenulls=True).over(w))

    def shared_bfill(self, s):
        return replace(s, col=_next_known(s.frame, s.col))

    def shared_interpolate(self, s, method="linear"):
        """Gaps between two values on a line between them, those after the last value kept at it."""
        if method != "linear":
            raise UnsupportedError(f"interpolate method={method!r}")
        w = Window.partitionBy().orderBy(*s.frame.sorted())
        n, c = F.row_number().over(w), s.col.cast("double")
        back, fore = (x.rowsBetween(Window.unboundedPreceding, 0) for x in (w, Window.partitionBy().orderBy(F.desc("__n"))))
        df = s.frame.df.withColumns({"__c": c, "__n": n}).withColumn("__at", F.when(F.col("__c").isNotNull(), F.col("__n")))
        a, b = F.last("__c", ignorenulls=True).over(back), F.last("__c", ignorenulls=True).over(fore)
        pa, pb = F.last("__at", ignorenulls=True).over(back), F.last("__at", ignorenulls=True).over(fore)
        line = F.when(F.col("__c").isNotNull(), F.col("__c")).when(b.isNotNull(), a + (b - a) * (F.col("__n") - pa) / (pb - pa)).otherwise(a)
        made = df.withColumn("__line", line).drop("__c", "__n", "__at")
        return Filled(replace(s.frame, df=made), F.col("__line"), s.name)

    def shared_quantile(self, s, q=0.5):
        return Series(Frame(s.frame.df.agg(F.percentile(s.col, F.lit(float(q))).alias(s.name)), ()), F.col(quoted(s.name)), s.name)

    def shared_unique(self, s):
        return Series(Frame(s.frame.df.select(s.col.alias(s.name)).distinct(), ()), F.col(quoted(s.name)), s.name)

    # --- groups and rolling frames ---

    def grouped_agg(self, g, spec=None, **named):
        aggs = []
        if isinstance(spec, dict):
            for c, fs in spec.items():
                fs = [fs] if isinstance(fs, str) else fs
                aggs += [{"column": c, "type": AGGREGATES[x], "outputColumn": c if len(fs) == 1 else f"{c}_{x}"} for x in fs]
        for out, (c, x) in named.items():
            aggs.append({"column": c, "type": AGGREGATES[x], "outputColumn": out})
        if isinstance(spec, str):
            aggs = [{"column": g.column, "type": AGGREGATES[spec], "outputColumn": g.column}]
        return Frame(relational.group(g.frame.df, g.keys, aggs, drop_null_keys=True), tuple(g.keys))

    grouped_aggregate = grouped_agg

    def grouped_one(self, g: Grouped, kind: str) -> Frame:
        cols = [g.column] if g.column else [c for c, t in g.frame.df.dtypes if c not in (*g.keys, POS) and t in ("int", "bigint", "double", "float")]
        aggs = [{"column": None, "type": "SIZE", "outputColumn": "size"}] if kind == "SIZE" else [{"column": c, "type": kind, "outputColumn": c} for c in cols]
        return Frame(relational.group(g.frame.df, g.keys, aggs, drop_null_keys=True), tuple(g.keys))

    def grouped_window(self, g: Grouped, name: str, args: list, kw: dict) -> Any:
        s = Series(g.frame, F.col(quoted(g.column or g.keys[0])), g.column or g.keys[0])
        w = Window.partitionBy(*[F.col(quoted(k)) for k in g.keys])
        if name == "transform":
            return replace(s, col=relational.aggregate(AGGREGATES[args[0]], g.column).over(w))
        if name == "rolling":
            return Rolling(g.frame, g.keys, s.col, s.name, args[0], kw.get("min_periods", args[0]))
        if name == "cumcount":
            return replace(s, col=F.row_number().over(w.orderBy(*g.frame.sorted())) - 1)
        kinds = {"cumsum": "RUNNING_SUM", "cummin": "RUNNING_MIN", "cummax": "RUNNING_MAX", "cumprod": "RUNNING_PRODUCT", "diff": "LAG_DIFF", "shift": "LAG", "pct_change": "PCT_CHANGE", "rank": "RANK"}
        if name not in kinds:
            raise UnsupportedError(f"groupby.{name}")
        n = args[0] if args else kw.get("periods", 1)
        if name == "rank":
            up = kw.get("ascending", True)
            return self.series_window(s, "RANK", method=kw.get("method", "average"), keys=g.keys, order=[s.col.asc_nulls_last() if up else s.col.desc_nulls_last()])
        return self.series_window(s, "LEAD" if name == "shift" and n < 0 else kinds[name], abs(n) if isinstance(n, int) else 1, keys=g.keys)

    def rolling_one(self, r: Rolling, kind: str) -> Series:
        w = Window.partitionBy(*[F.col(quoted(k)) for k in r.keys]).orderBy(*r.frame.sorted())
        frame = w.rowsBetween(Window.unboundedPreceding if r.size is None else -(r.size - 1), 0)
        f = relational._agg_over(kind, r.col).over(frame)
        return Series(r.frame, F.when(F.count(r.col).over(frame) >= (r.min_periods or 1), f), r.name)

    # --- text and dates ---

    def date_call(self, s: Series, name: str, args: list) -> Series:
        if name == "strftime":
            return replace(s, col=F.date_format(s.col, _java_format(args[0])))
        if name == "tz_localize":
            return s
        if name == "total_seconds":
            return replace(s, col=s.col.cast("bigint").cast("double"))
        raise UnsupportedError(f".dt.{name}")

    def _text(self, a: Accessor, f) -> Series:
        if a.kind != "str":
            raise UnsupportedError(f".{a.kind} method")
        return replace(a.series, col=f(a.series.col))

    def text_upper(self, a): return self._text(a, F.upper)  # noqa: E704
    def text_lower(self, a): return self._text(a, F.lower)  # noqa: E704
    def text_title(self, a): return self._text(a, modes.STRING["TITLECASE"])  # noqa: E704
    def text_capitalize(self, a): return self._text(a, modes.STRING["CAPITALIZE"])  # noqa: E704
    def text_swapcase(self, a): return self._text(a, modes.STRING["SWAPCASE"])  # noqa: E704
    def text_strip(self, a): return self._text(a, modes.STRING["TRIM"])  # noqa: E704
    def text_lstrip(self, a): return self._text(a, modes.STRING["TRIM_LEFT"])  # noqa: E704
    def text_rstrip(self, a): return self._text(a, modes.STRING["TRIM_RIGHT"])  # noqa: E704
    def text_len(self, a): return self._text(a, F.length)  # noqa: E704
    def text_contains(self, a, p, case=True, regex=True): return self._text(a, lambda c: F.coalesce(c.rlike(p if case else "(?i)" + p) if regex else c.contains(p), F.lit(False)))  # noqa: E704
    def text_startswith(self, a, p): return self._text(a, lambda c: F.coalesce(c.startswith(p), F.lit(False)))  # noqa: E704
    def text_endswith(self, a, p): return self._text(a, lambda c: F.coalesce(c.endswith(p), F.lit(False)))  # noqa: E704
    def text_replace(self, a, p, r, regex=False): return self._text(a, lambda c: F.regexp_replace(c, p, r) if regex else F.replace(c, F.lit(p), F.lit(r)))  # noqa: E704
    def text_extract(self, a, p, expand=False): return self._text(a, lambda c: F.when(c.rlike(p), F.regexp_extract(c, p, 1)))  # noqa: E704
    def text_zfill(self, a, n): return self._text(a, lambda c: modes.STRING["PAD_LEFT"](c, n, "0"))  # noqa: E704
    def text_split(self, a, sep=" "): return self._text(a, lambda c: F.split(c, "\\Q" + sep + "\\E"))  # noqa: E704
    def text_get(self, a, i): return self._text(a, lambda c: F.get(c, F.lit(i)))  # noqa: E704
    def text_slice(self, a, start=0, stop=None): return self._text(a, lambda c: F.substring(c, start + 1, stop - start) if stop else F.substr(c, F.lit(start + 1)))  # noqa: E704


def _numbers(f: str, args: list) -> list:
    """A list of plain numbers, as NumPy makes it."""
    if f == "arange":
        start, stop, step = (0, args[0], 1) if len(args) == 1 else (args[0], args[1], args[2] if len(args) > 2 else 1)
        return [start + step * i for i in range(max(0, -int(-(stop - start) // step)))]
    if f == "linspace":
        n = int(args[2]) if len(args) > 2 else 50
        return [args[0] + (args[1] - args[0]) * i / (n - 1) for i in range(n)] if n > 1 else [args[0]] * n
    return [{"zeros": 0.0, "ones": 1.0}.get(f, args[1] if len(args) > 1 else 0)] * int(args[0])


def _over(s: Series, kind: str, w, n: int | None, method: str) -> Column:
    """A window function over an expression: the same as over a named column."""
    c, k = s.col, int(n or 1)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    if kind == "RANK":
        return F.when(c.isNotNull(), relational.window_function("RANK", None, w, method=method))
    return {
        "RUNNING_SUM": lambda: F.when(c.isNotNull(), F.sum(c).over(run)), "RUNNING_MIN": lambda: F.when(c.isNotNull(), F.min(c).over(run)), "RUNNING_MAX": lambda: F.when(c.isNotNull(), F.max(c).over(run)), "RUNNING_PRODUCT": lambda: F.when(c.isNotNull(), F.product(c).over(run)),
        "LAG": lambda: F.lag(c, k).over(w), "LEAD": lambda: F.lead(c, k).over(w), "LAG_DIFF": lambda: c - F.lag(c, k).over(w), "PCT_CHANGE": lambda: F.try_divide(c.cast("double"), F.lag(c, k).over(w)) - 1,
    }[kind]()


def _flip(c: Column) -> Column:
    text = c._jc.toString() if hasattr(c, "_jc") else str(c)
    bare, down, first = re.fullmatch(r"(.*?)(?: (?:ASC|(DESC))(?: NULLS (?:LAST|(FIRST)))?)?", text, re.DOTALL).groups()
    col = F.col(quoted(bare[1:-1].replace("``", "`") if bare[:1] == "`" else bare))
    if down:
        return col.asc_nulls_last() if first else col.asc_nulls_first()
    return col.desc_nulls_last() if first else col.desc_nulls_first()


def _next_known(f: Frame, c: Column) -> Column:
    """The first value at or after each row. A frame that ends at the last row would be gone through
    again for every row, so that it is a running frame over the rows in reverse."""
    order = [_flip(x) if isinstance(x, Column) else F.desc(x) for x in f.order if isinstance(x, Column) or x in f.df.columns]
    if not order:
        return F.first(c, ignorenulls=True).over(Window.partitionBy().orderBy(F.lit(0)).rowsBetween(0, Window.unboundedFollowing))
    return F.last(c, ignorenulls=True).over(Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def _bin_expr(s: Series, mode: str, n: Any, labels: Any) -> Column:
    df = s.frame.df.select(s.col.alias("__v"))
    if mode == "CUSTOM_BOUNDARIES":
        edges = n
    elif mode == "EQUAL_WIDTH":
        lo, hi = df.agg(F.min("__v"), F.max("__v")).first()
        edges = [lo + (hi - lo) * i / n for i in range(n + 1)]
    else:
        edges = df.agg(F.percentile("__v", F.array(*[F.lit(i / n) for i in range(n + 1)]))).first()[0]
    code = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        low = (s.col >= edges[i]) if i == 0 and mode != "CUSTOM_BOUNDARIES" else (s.col > edges[i])
        code = F.when(low & (s.col <= edges[i + 1]), i).otherwise(code)
    return F.get(F.array(*[F.lit(x) for x in labels]), code) if labels else code


def _java_format(fmt: str) -> str:
    out = fmt
    for a, b in (("%Y", "yyyy"), ("%m", "MM"), ("%d", "dd"), ("%H", "HH"), ("%M", "mm"), ("%S", "ss"), ("%y", "yy"), ("%b", "MMM"), ("%B", "MMMM"), ("%A", "EEEE"), ("%j", "DDD")):
        out = out.replace(a, b)
    return out


def store(outputs: dict[str, Frame], folder: str) -> list[str]:
    """Write the outputs of a program below ``folder`` in the format their path asks for."""
    formats = {"csv": "csv", "parquet": "parquet", "json": "json", "feather": "parquet", "pkl": "parquet", "pickle": "parquet", "xlsx": "csv"}
    for path, frame in outputs.items():
        end = path.rsplit(".", 1)[-1].lower()
        if end not in formats:
            raise UnsupportedError(f"output {path!r}")
        io.write(frame.df.drop(POS), {"format": formats[end], "path": f"{folder}/{path}"})
    return sorted(outputs)


def compile_source(code: str, inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All variables of a program that are tables or columns, as lazy DataFrames."""
    return Compiler(inputs).run(code)

"""Designs: grids of parameters that become tables of runs.

A design maps keys to lists of alternatives. A spec set holds designs, rules that drop rows, and keys removed by the null
mark; ``table`` expands it on the executors: row i of a design takes, for each key, the alternative that i's mixed-radix digits name, so
no join is needed, ids are known beforehand and any slice can be made alone.
"""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import display_double, fill, hash_mod
from ..operators.lineage import numbered

#: Fixed values of designs: the mark that removes a key, the size of a grid that earns a warning, words that runs own.
NULL, MANY = "_null", 2_000_000
SPECIAL = ("_refdir", "_repeat", "_format", "_measures")
RESERVED = ("_spec", "_expe_id", "_expe_name", "_expe_hash", "_pmk")


def listed(values: Mapping) -> dict[str, list]:
    """Each value as a list of alternatives."""
    return {k: list(v) if isinstance(v, (list, tuple)) else [v] for k, v in values.items()}


def short_model(name: str) -> str:
    return str(name).rsplit(".", 1)[-1]


@dataclass(frozen=True)
class Design:
    """One grid, with the name and aliases its rows carry."""

    keys: dict[str, list]
    name: str = "expe"
    aliases: dict[str, dict[str, str]] = field(default_factory=dict)

    @staticmethod
    def of(values: Mapping, name: str = "expe", **more) -> Design:
        return Design(listed(values), name, more)

    def overlay(self, values: Mapping, typed: Iterable[str] | None = None) -> Design:
        """Values of the command line over the grid's; with ``typed`` only those keys replace existing ones."""
        new = {k: v for k, v in listed(values).items() if typed is None or k in set(typed) or k not in self.keys}
        return replace(self, keys=self.keys | new)

    def defaults(self, values: Mapping) -> Design:
        return replace(self, keys=listed(values) | self.keys)

    def without(self, *keys: str) -> Design:
        return replace(self, keys={k: v for k, v in self.keys.items() if k not in keys})

    def nulled(self) -> tuple[Design, list[str]]:
        """Keys with the null mark among their alternatives go, and are named."""
        gone = [k for k, v in self.keys.items() if NULL in v]
        return self.without(*gone), gone

    def per_model(self) -> list[Design]:
        """A design for each model, in order, with that model's own ``model__parameter`` keys only."""
        scoped = {k for k in self.keys if "__" in k.strip("_") and k.split("__")[0]}
        models = self.keys.get("model")
        if not models:
            return [self]
        keep = lambda m: {k: v for k, v in self.keys.items() if k not in scoped or k.split("__")[0] == short_model(m)}
        return [replace(self, keys=keep(m) | {"model": [m]}) for m in models]

    def size(self) -> int:
        return math.prod(len(v) for v in self.keys.values())

    def expanded_size(self) -> int:
        return sum(d.size() for d in self.per_model())

    def rows(self, spark: SparkSession) -> DataFrame:
        """Rows of one model's grid in order: keys sorted, the last one fastest; ``_pos`` is the place in the grid."""
        df = spark.range(self.size()).withColumnRenamed("id", "_pos")
        stride = self.size()
        columns = {}
        for key in sorted(self.keys):
            values = self.keys[key]
            stride //= len(values)
            at = (F.floor(F.col("_pos") / F.lit(stride)) % len(values)).cast("int")
            columns[key] = F.element_at(literal_array(values), at + 1)
        return df.withColumns(columns)


def checked(design: Design) -> Design:
    """The design, if no key is a word that runs own and each key has a list of alternatives."""
    for key, values in design.keys.items():
        if key in RESERVED and key != "_expe_name":
            raise ValueError(f"{key} is a reserved word")
        if not isinstance(values, (list, tuple, set)):
            raise ValueError(f"the alternatives of {key} are not a list")
    return design


def with_measures(design: Design) -> Design:
    """Measures given as one text become the list of its words."""
    found = design.keys.get("_measures")
    return design if found is None else replace(design, keys=design.keys | {"_measures": [x.split() if isinstance(x, str) else x for x in found]})


def with_vectors(design: Design, vectors: Mapping[str, list]) -> Design:
    """Alternatives that name a vector of the catalogue are replaced by its items; lists among them go, other values stay."""
    out = {}
    for key, values in design.keys.items():
        found = [y for x in values if not isinstance(x, list) for y in (vectors[x] if isinstance(x, str) and x in vectors else [x])]
        out[key] = found or values
    return replace(design, keys=out)


def positions(values: Column) -> Column:
    """(position as text, value) of each item of a list, for ``explode``."""
    return F.transform(values, lambda x, i: F.struct(i.cast("string").alias("position"), x.alias("value")))


#: Keys that a run drops before it is called, with the value that makes it drop (None: any). Fixed values.
INTERNAL = {"_ignore_format_unique": None, "_net": False}


def cleaned_runs(runs: DataFrame, template: str | None = None, write: bool = False) -> DataFrame:
    """Runs ready to be called: if several are to write, their template must tell them apart; then internal keys go."""
    if write and template and runs.limit(2).count() > 1:
        missing = [r["key"] for r in unformatted_keys(runs, template).collect()]
        if missing and "_ignore_format_unique" not in runs.columns:
            raise ValueError(f"the name template leaves out {', '.join(sorted(missing))}: runs would share a file")
    for key, value in INTERNAL.items():
        if key in runs.columns:
            keep = F.lit(None) if value is None else F.when(F.col(key) == value, None).otherwise(F.col(key))
            runs = runs.drop(key) if value is None or runs.where(keep.isNotNull()).isEmpty() else runs.withColumn(key, keep)
    return runs


def input_path(corpus: Column, root: str = "data", extensions: Iterable[str] = ("pk", "pickle", "gt", "txt", "csv", "dat")) -> Column:
    """root/training/corpus: generated graphs have a folder of their own and the name Graph; a known extension goes."""
    c = F.coalesce(corpus, F.lit(""))
    made = F.concat(F.lit("generator/"), F.replace(F.replace(c, F.lit("generator"), F.lit("Graph")), F.lit("graph"), F.lit("Graph")))
    c = F.when(F.lower(c).rlike("^(clique|graph|generator)"), made).otherwise(c)
    return F.concat_ws("/", F.lit(root), F.lit("training"), F.regexp_replace(c, r"\.(" + "|".join(extensions) + ")$", ""))


def tagged(runs: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Runs with ``_expe_hash`` (an md5 of their keys) and ``_alias`` (their name, by its alias where it has one)."""
    return runs.withColumns({"_expe_hash": run_hash(runs), "_alias": alias(F.col("_expe_name"), aliases or {})})


def global_tensor(sets: SpecSet, spark: SparkSession) -> DataFrame:
    """(key, values): the alternatives of each key over all grids, grid after grid, as text. Grids are few and small; their rows are not made."""
    rows = [(k, t, i, str(v)) for t, d in enumerate(sets.designs) for k, values in d.keys.items() for i, v in enumerate(values)]
    long = spark.createDataFrame(rows, "key string, t int, i int, value string")
    return long.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "i", "value"))), lambda x: x["value"]).alias("values"))


def plot_request(text: str) -> dict:
    """``g1/g2:attr@r``: groups, attribute and the key of repeats; without a text the entropy by corpus."""
    groups, _, attribute = text.rpartition(":") if text else ("corpus", "", "_entropy")
    attribute, _, options = attribute.partition("@")
    return {"groups": groups.split("/") if groups else None, "attribute": attribute, "repeat": options[0] if options else None}


def table_request(text: str, more: str = "") -> dict:
    """``x:y:z`` and the tables asked for: ``a/b`` one for each group, ``a,b`` groups with | between them in headers."""
    x, y, z = text.split(":") if text else ("corpus", "model", "_entropy")
    listed_ = "," in more
    return {"x": x, "y": y, "z": z.split("-"), "groups": more.split("," if listed_ else "/") if more else None, "split": ("|" if listed_ else "/") if more else None}


def locate(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(name, module, object): spec names with the module and object that the catalogue (name, module, object) has for them; null where it has none."""
    return names.join(catalogue, "name", "left")


def literal_array(values: list) -> Column:
    """A literal array of one type; values of several types become text."""
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {bool} or kinds <= {int} or kinds <= {int, float} or kinds <= {str}:
        kind = "boolean" if kinds <= {bool} and kinds else "long" if kinds == {int} else "double" if kinds & {float} else "string"
        return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
    return F.array(*[F.lit(v if isinstance(v, str) else json.dumps(v, sort_keys=True)) for v in values])


@dataclass(frozen=True)
class Rule:
    """A row rule: rows where some value is ``a`` must (or, negated, must not) hold ``b``, or have ``key`` equal to ``b``."""

    a: str
    b: str
    key: str | None = None
    negated: bool = False

    @staticmethod
    def parse(text: str) -> Rule | None:
        """``a.b``, ``a.!b``, ``a.key.c`` or ``a.key.!c``; other numbers of parts make no rule."""
        parts = text.split(".")
        if len(parts) not in (2, 3):
            return None
        last = parts[-1]
        return Rule(parts[0], last.removeprefix("!"), parts[1] if len(parts) == 3 else None, last.startswith("!"))

    def keeps(self, columns: Mapping[str, str]) -> Column:
        """The rows that stay. columns: name and Spark type of each key; null where the key is missing."""
        texts = [F.col(f"`{c}`") for c, kind in columns.items() if kind == "string" and not c.startswith("_")]
        holds = lambda x: reduce(lambda p, q: p | q, [F.coalesce(F.element_at(F.split(t, r"\."), -1) == x, F.lit(False)) for t in texts], F.lit(False))
        if self.key is None:
            hit = holds(self.b)
        elif self.key not in columns:
            raise KeyError(f"a rule names the key {self.key}, which no row has")
        else:
            kind = columns[self.key]
            value = F.lit(self.b in ("True", "true", "1")) if kind == "boolean" else F.lit(self.b).cast(kind)
            hit = F.coalesce(F.col(f"`{self.key}`") == value, F.lit(False))
        return ~(holds(self.a) & (hit if self.negated else ~hit))


def rules_of(rules: str | Iterable | None) -> list[Rule]:
    """Rules from a string, a list or nested lists."""
    if rules is None:
        return []
    if isinstance(rules, str):
        return [r for x in rules.split() if (r := Rule.parse(x))]
    return [r for x in rules for r in rules_of(x)]


@dataclass(frozen=True)
class SpecSet:
    designs: list[Design]
    rules: list[Rule] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)

    @staticmethod
    def of(*specs: Mapping | Design | Iterable, rules: str | Iterable | None = None, **over) -> SpecSet:
        """From grids, designs, or nested groups of them; ``over`` replaces values in every leaf."""

        def flat(x):
            if isinstance(x, Design):
                yield x
            elif isinstance(x, Mapping):
                yield Design(listed(x))
            else:
                for y in x:
                    yield from flat(y)

        designs, removed = [], []
        for d in flat(specs):
            checked(d)
            d, gone = (d.overlay(over) if over else d).nulled()
            designs.append(d)
            removed += gone
        made = SpecSet(designs, rules_of(rules), list(dict.fromkeys(removed)))
        if made.size() > MANY:
            warnings.warn(f"{made.size()} runs before rules", stacklevel=2)
        return made

    def size(self) -> int:
        """Rows before rules, without making them."""
        return sum(d.expanded_size() for d in self.designs)

    def concat(self, other: SpecSet) -> SpecSet:
        return replace(self, designs=self.designs + other.designs, rules=self.rules + other.rules, removed=list(dict.fromkeys(self.removed + other.removed)))

    def raw(self, spark: SparkSession) -> DataFrame:
        """All rows after the rules, with ``_tensor``, ``_model`` and ``_pos`` as their order."""
        parts = []
        for t, design in enumerate(self.designs):
            for m, one in enumerate(design.per_model()):
                if one.keys:
                    parts.append(one.rows(spark).withColumns({"_tensor": F.lit(t), "_model": F.lit(m), "_expe_name": F.lit(design.name)}))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        kinds = {c: t for c, t in df.dtypes if not c.startswith("_")}
        for rule in self.rules:
            df = df.where(rule.keeps(kinds))
        return df

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per run; ``_expe_id`` counts rows that the rules keep, in order."""
        return numbered(self.raw(spark), "_expe_id", F.col("_tensor"), F.col("_model"), F.col("_pos")).drop("_tensor", "_model", "_pos")

    def keys(self) -> list[str]:
        return sorted({k for d in self.designs for k in d.keys})


def select_rows(runs: DataFrame, indices: list[int]) -> DataFrame:
    """Rows by id in the order of the list; ``_order`` is the place in it."""
    wanted = runs.sparkSession.createDataFrame(list(enumerate(indices)), "_order long, _expe_id long")
    return runs.join(F.broadcast(wanted), "_expe_id")


def canonical(columns: Mapping[str, str]) -> Column:
    """A row as JSON with sorted keys and ', ' and ': ' between, nulls kept: what its identity is hashed from."""

    def shown(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "string":
            text = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        elif kind in ("double", "float"):
            text = python_double(c)
        else:
            text = c.cast("string")
        return F.concat(F.lit(json.dumps(name) + ": "), F.coalesce(text, F.lit("null")))

    return F.concat(F.lit("{"), F.concat_ws(", ", *[shown(n, columns[n]) for n in sorted(columns)]), F.lit("}"))


def python_double(c: Column) -> Column:
    """A double as the shortest decimal with a two-digit exponent."""
    text = F.lower(c.cast("string"))
    return F.regexp_replace(F.regexp_replace(text, r"\.0e", "e"), r"e(-?)(\d)$", r"e$10$2")


def run_hash(runs: DataFrame, keys: Iterable[str] | None = None) -> Column:
    kinds = {c: t for c, t in runs.dtypes if (c in set(keys) if keys is not None else not c.startswith("_"))}
    return F.md5(canonical(kinds))


def long_form(runs: DataFrame) -> DataFrame:
    """(_expe_id, key, value, kind) of every present key: the form of key-wise operators."""
    pairs = [F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value"), F.lit(t).alias("kind")) for c, t in runs.dtypes if not c.startswith("_")]
    return runs.select("_expe_id", F.explode(F.array(*pairs)).alias("kv")).select("_expe_id", "kv.*").where("value is not null")


def gridded_keys(runs: DataFrame) -> DataFrame:
    """Text keys with several values (numbers are never reported, nor texts that begin with _)."""
    long = long_form(runs).where((F.col("kind") == "string") & ~F.col("value").startswith("_"))
    return long.groupBy("key").agg(F.countDistinct("value").alias("n_values")).where("n_values > 1")


def constant_keys(runs: DataFrame) -> DataFrame:
    """Keys that every run has with one value."""
    total = runs.agg(F.count("*").alias("total"))
    found = long_form(runs).groupBy("key").agg(F.countDistinct("value").alias("d"), F.count("*").alias("n"), F.min("value").alias("value"))
    return found.crossJoin(F.broadcast(total)).where("d = 1 and n = total").select("key", "value")


def value_sets(runs: DataFrame) -> DataFrame:
    """(key, value, n): the values of each key with their multiplicity."""
    return long_form(runs).groupBy("key", "value").agg(F.count("*").alias("n"))


def duplicates(runs: DataFrame) -> DataFrame:
    """Hashes that several runs share."""
    return runs.groupBy(run_hash(runs).alias("hash")).agg(F.count("*").alias("n")).where("n > 1")


def minus(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left whose values right lacks; repeats of left stay."""
    same = reduce(lambda p, q: p & q, [left[c].eqNullSafe(right[c]) for c in on])
    return left.join(right.select(on).distinct(), same, "left_anti")


def spec_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, value): values of a key that only one side has; a key that one side lacks also shows the mark --."""
    a, b = (long_form(x).select("key", "value").distinct() for x in (left, right))
    ka, kb = a.select("key").distinct(), b.select("key").distinct()
    lone = ka.join(kb, "key", "left_anti").union(kb.join(ka, "key", "left_anti")).select("key", F.lit("--").alias("value"))
    return a.join(b, ["key", "value"], "left_anti").union(b.join(a, ["key", "value"], "left_anti")).union(lone)


def diff_all(tables: list[DataFrame]) -> DataFrame:
    """(key, value) of ``spec_diff`` folded from the left: each further table is compared with the difference so far."""
    first, *rest = tables
    out = spec_diff(first, rest[0])
    for more in rest[1:]:
        pairs = long_form(more).select("key", "value").distinct()
        lone = out.select("key").distinct().join(pairs.select("key").distinct(), "key", "left_anti").union(pairs.select("key").distinct().join(out.select("key").distinct(), "key", "left_anti"))
        out = out.join(pairs, ["key", "value"], "left_anti").union(pairs.join(out, ["key", "value"], "left_anti")).union(lone.select("key", F.lit("--").alias("value"))).distinct()
    return out


def used_names(template: str) -> Column:
    return F.regexp_extract_all(F.lit(template), F.lit(r"\{([^{}]*)\}"), F.lit(1))


def unformatted_keys(runs: DataFrame, template: str) -> DataFrame:
    """Gridded keys that a file name template does not use: runs that differ in them only would collide."""
    return gridded_keys(runs).where(~F.array_contains(used_names(template), F.col("key"))).select("key")


def path_value(c: Column, kind: str) -> Column:
    """A value for file names: lists and maps by hash, floats by the display rule."""
    if kind.startswith(("array", "map", "struct")):
        return F.concat(hash_mod(F.md5(F.to_json(c))).cast("string"), F.lit("h"))
    return display_double(c) if kind in ("double", "float") else c.cast("string")


def output_path(runs: DataFrame, template: str | None = None, root: str = "results", ext: str = "") -> Column:
    """results/refdir/repeat/name of each run; without a template the name is hash-name."""
    kinds = dict(runs.dtypes)
    if template:
        names = {c: path_value(F.col(f"`{c}`"), t) for c, t in kinds.items()}
        name = fill(template, names | {c.removeprefix("_"): v for c, v in names.items() if c.startswith("_")})
    else:
        name = F.concat_ws("-", run_hash(runs), F.col("_expe_name"))
    head = [F.lit(root)] + [F.col(c).cast("string") for c in ("_refdir", "_repeat") if c in kinds]
    return F.concat_ws("/", *head, F.concat(name, F.lit(ext)))


def unfinished(runs: DataFrame, outputs: DataFrame, path: Column) -> DataFrame:
    """Runs whose output path is not among the finished ones."""
    return runs.withColumn("path", path).join(outputs.where("size > 0").select("path"), "path", "left_anti")


def finished(runs: DataFrame, outputs: DataFrame, path: Column) -> DataFrame:
    """Runs whose output path is among the finished ones, with the path."""
    return runs.withColumn("path", path).join(outputs.where("size > 0").select("path"), "path", "left_semi")


def alias(c: Column, names: Mapping[str, str]) -> Column:
    if not names:
        return c
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(table, c), c)


def shown_rows(runs: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Runs as they are displayed: each value by its alias (in lists, each item), missing ones as the text None."""
    out = []
    for c, kind in runs.dtypes:
        x = F.col(f"`{c}`")
        if kind.startswith("array"):
            text = F.array_join(F.transform(x, lambda v: alias(v.cast("string"), names)), " ", "None")
        else:
            text = alias(x.cast("string"), names)
        out.append(F.coalesce(text, F.lit("None")).alias(c))
    return runs.select(*out)


def seed_column(text: Column, repeat: Column | None = None) -> Column:
    """A run's seed from the characters of its seed text (each times a power of 31) and its repeat, modulo 2**32."""
    total = F.aggregate(F.reverse(F.split(text, "")), F.lit(0).cast("long"), lambda a, c: (a * 31 + F.ascii(c)) % (1 << 32))
    return (total + (repeat if repeat is not None else 0)) % (1 << 32)


def model_name(c: Column, package: str) -> Column:
    """Names without a package get the default one's short form (first three letters and initials when long), in lower case."""
    head = package if len(package) <= 8 else package[:3] + "".join(x[0] for x in package.split("_")[1:])
    return F.lower(F.when(c.contains("."), c).otherwise(F.concat(F.lit(head + "."), c)))


def pack_rows(runs: DataFrame, by: list[str]) -> DataFrame:
    """Selected rows back into alternatives per key (an over-approximation: the rows stay authoritative)."""
    rest = [c for c in runs.columns if c not in by and not c.startswith("_")]
    return runs.groupBy(*by).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in rest])

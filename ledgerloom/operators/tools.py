"""Tool calls as a table: each is met with a result row, whatever its name and arguments.

A tool is a name, the types of its arguments and a builder, which makes of a DataFrame of calls
(``call_id`` and the arguments as columns) one of ``call_id, content`` and, if it has them,
``is_error`` and ``proposal``.  So all calls of a tool are answered by one plan, not one by one.
Arguments come as JSON text and are checked against the types before the builder sees
them; unknown names, arguments that do not fit and calls that a builder leaves out are
results with ``is_error``, for the caller to correct.  Nothing here can write outside:
a tool that proposes a change answers with the proposal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import steps

#: Types of arguments: what their JSON value is, and the column's type.
TYPES = {"string": (("STRING",), "string"), "integer": (("BIGINT",), "bigint"), "number": (("BIGINT", "DOUBLE", "DECIMAL"), "double"), "boolean": (("BOOLEAN",), "boolean"), "strings": (("ARRAY<STRING>", "ARRAY<VOID>"), "array<string>")}
PROPOSAL = "struct<issue_key: string, action_type: string, rationale: string, evidence: array<string>>"


@dataclass(frozen=True)
class Tool:
    name: str
    build: Callable[[DataFrame], DataFrame]
    arguments: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    description: str = ""
    writes: bool = False
    #: How the tool's answers are labelled when they are cited.
    label: str = ""

    def __post_init__(self):
        odd = [t for t in self.arguments.values() if t not in TYPES] + [r for r in self.required if r not in self.arguments]
        if odd:
            raise ValueError(f"tool {self.name}: unknown types or arguments {odd}")

    def fault(self, v: Column) -> Column:
        """Why parsed arguments do not fit, or null: the first of no object, one that is missing, one not known, one of another type."""
        kind = lambda name: F.schema_of_variant(F.try_variant_get(v, f'$["{name}"]', "variant"))
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        faults = [F.when(v.isNull() | keys.isNull(), "not an object")]
        absent = lambda name: F.try_variant_get(v, f'$["{name}"]', "variant").isNull() | (kind(name) == "VOID")
        faults += [F.when(absent(name), f"missing argument '{name}'") for name in self.required]
        other = F.filter(keys, lambda k: ~k.isin(*self.arguments)) if self.arguments else keys
        faults.append(F.when(F.size(other) > 0, F.concat(F.lit("unexpected argument '"), F.array_min(other), F.lit("'"))))

        def fits(name, spec):
            k = kind(name)
            return F.coalesce(absent(name), F.lit(True)) | reduce(lambda a, b: a | b, [k.startswith(t) for t in TYPES[spec][0]])

        faults += [F.when(~fits(name, spec), f"argument '{name}' is no {spec}") for name, spec in self.arguments.items()]
        return F.coalesce(*faults)

    def typed(self, v: Column) -> list[Column]:
        return [F.try_variant_get(v, f'$["{name}"]', TYPES[spec][1]).alias(name) for name, spec in self.arguments.items()]


@dataclass(frozen=True)
class Registry:
    tools: tuple[Tool, ...] = ()

    def __post_init__(self):
        names = [t.name for t in self.tools]
        if len(set(names)) < len(names):
            raise ValueError("two tools have one name")

    def register(self, *tools: Tool) -> Registry:
        return replace(self, tools=(*self.tools, *tools))

    def read_only(self) -> Registry:
        """Without the tools that propose changes: what is not offered cannot be called."""
        return Registry(tuple(t for t in self.tools if not t.writes))

    def labels(self) -> dict[str, str]:
        return {t.name: t.label for t in self.tools}

    def schemas(self) -> Iterable[dict]:
        """What a model is told of each tool."""
        kinds = lambda spec: {"type": "array", "items": {"type": "string"}} if spec == "strings" else {"type": spec}
        return [{"name": t.name, "description": t.description, "input_schema": {"type": "object", "properties": {n: kinds(s) for n, s in t.arguments.items()}, "required": list(t.required)}} for t in self.tools]

    def checked(self, calls: DataFrame) -> DataFrame:
        """``call_id, name, told`` and every tool's arguments: ``told`` says why a call cannot be made, null if it can. Written, so that a call is parsed once, however many tools there are."""
        rows = calls.select("call_id", "name", F.try_parse_json(F.coalesce("arguments", F.lit("{}"))).alias("v"))
        names = [t.name for t in self.tools]
        known = F.coalesce(F.col("name").isin(*names), F.lit(False)) if names else F.lit(False)
        told = F.when(~known, F.concat(F.lit("Unknown tool '"), F.coalesce("name", F.lit("")), F.lit(f"'. Available: {', '.join(sorted(names))}")))
        for tool in self.tools:
            told = told.when(F.col("name") == tool.name, F.concat(F.lit(f"Invalid arguments for {tool.name}: "), tool.fault(F.col("v"))))
        rows = rows.withColumn("told", told)
        arguments = [F.when((F.col("name") == tool.name) & F.col("told").isNull(), a).alias(f"{k}_{j}") for k, tool in enumerate(self.tools) for j, a in enumerate(tool.typed(F.col("v")))]
        return steps.written(rows.select("call_id", "name", "told", *arguments), "calls")

    def execute(self, calls: DataFrame) -> DataFrame:
        """``call_id, name, content, is_error, proposal`` of ``call_id, name, arguments``, one row a call; ids are unique."""
        none = F.lit(None).cast(PROPOSAL).alias("proposal")
        rows = self.checked(calls)
        out = [rows.where("told is not null").select("call_id", "name", F.col("told").alias("content"), F.lit(True).alias("is_error"), none)]
        for k, tool in enumerate(self.tools):
            good = rows.where((F.col("name") == tool.name) & F.col("told").isNull())
            made = tool.build(good.select("call_id", *[F.col(f"{k}_{j}").alias(name) for j, name in enumerate(tool.arguments)]))
            has = made.columns
            answer = made.select(
                "call_id", F.col("content"), (F.coalesce("is_error", F.lit(False)) if "is_error" in has else F.lit(False)).alias("is_error"), F.col("proposal").cast(PROPOSAL).alias("proposal") if "proposal" in has else none, F.lit(True).alias("there"),
            )
            met = good.select("call_id", "name").join(answer, "call_id", "left")
            out.append(met.select("call_id", "name", F.when(F.col("there"), F.col("content")).otherwise(f"Tool {tool.name} failed: no result").alias("content"), F.coalesce("is_error", F.lit(True)).alias("is_error"), "proposal"))
        return reduce(DataFrame.unionByName, out)


def flag_tool() -> Tool:
    """Proposes to flag an issue as at risk; without evidence it refuses.  Its texts are fixed values."""

    def build(calls: DataFrame) -> DataFrame:
        cited = F.size("evidence_rule_ids") > 0
        key = F.upper("issue_key")
        told = F.concat(F.lit("Proposed flagging "), key, F.lit(" as at-risk. AWAITING HUMAN APPROVAL — nothing has been written to Jira."))
        refused = "Rejected: a flag proposal requires at least one supporting rule id from get_risk_findings."
        proposal = F.struct(key.alias("issue_key"), F.lit("flag_at_risk").alias("action_type"), F.col("rationale"), F.col("evidence_rule_ids").alias("evidence"))
        return calls.select("call_id", F.when(cited, told).otherwise(refused).alias("content"), (~cited).alias("is_error"), F.when(cited, proposal).alias("proposal"))

    return Tool("propose_flag_at_risk", build, {"issue_key": "string", "rationale": "string", "evidence_rule_ids": "strings"}, ("issue_key", "rationale", "evidence_rule_ids"), writes=True, label="Proposed change — awaiting approval, not written to Jira")

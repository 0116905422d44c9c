"""Physical operators by the names of a fixed vocabulary, whichever engine made the plan."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

# The vocabulary.
VOCABULARY = (
    "TABLE_SCAN",
    "DUMMY_SCAN",
    "CHUNK_SCAN",
    "COLUMN_DATA_SCAN",
    "DELIM_SCAN",
    "ORDER_BY",
    "LIMIT",
    "LIMIT_PERCENT",
    "STREAMING_LIMIT",
    "RESERVOIR_SAMPLE",
    "STREAMING_SAMPLE",
    "TOP_N",
    "WINDOW",
    "STREAMING_WINDOW",
    "UNNEST",
    "UNGROUPED_AGGREGATE",
    "HASH_GROUP_BY",
    "PERFECT_HASH_GROUP_BY",
    "PARTITIONED_AGGREGATE",
    "FILTER",
    "PROJECTION",
    "COPY_TO_FILE",
    "BATCH_COPY_TO_FILE",
    "LEFT_DELIM_JOIN",
    "RIGHT_DELIM_JOIN",
    "BLOCKWISE_NL_JOIN",
    "NESTED_LOOP_JOIN",
    "HASH_JOIN",
    "PIECEWISE_MERGE_JOIN",
    "IE_JOIN",
    "ASOF_JOIN",
    "CROSS_PRODUCT",
    "POSITIONAL_JOIN",
    "POSITIONAL_SCAN",
    "UNION",
    "INSERT",
    "BATCH_INSERT",
    "DELETE_OPERATOR",
    "UPDATE",
    "MERGE_INTO",
    "EMPTY_RESULT",
    "CREATE_TABLE",
    "CREATE_TABLE_AS",
    "BATCH_CREATE_TABLE_AS",
    "CREATE_INDEX",
    "EXPLAIN",
    "EXPLAIN_ANALYZE",
    "EXECUTE",
    "VACUUM",
    "RECURSIVE_CTE",
    "RECURSIVE_KEY_CTE",
    "CTE",
    "RECURSIVE_CTE_SCAN",
    "RECURSIVE_RECURRING_CTE_SCAN",
    "CTE_SCAN",
    "EXPRESSION_SCAN",
    "ALTER",
    "CREATE_SEQUENCE",
    "CREATE_VIEW",
    "CREATE_SCHEMA",
    "CREATE_MACRO",
    "CREATE_SECRET",
    "DROP",
    "PRAGMA",
    "TRANSACTION",
    "PREPARE",
    "EXPORT",
    "SET",
    "SET_VARIABLE",
    "RESET",
    "LOAD",
    "INOUT_FUNCTION",
    "CREATE_TYPE",
    "ATTACH",
    "DETACH",
    "RESULT_COLLECTOR",
    "EXTENSION",
    "PIVOT",
    "COPY_DATABASE",
    "VERIFY_VECTOR",
    "UPDATE_EXTENSIONS",
    "ROOT",
)
#: The vocabulary's name of each of Spark's nodes that has one. Exchanges, local sorts and code generation have none.
NODES = {
    "Scan": "TABLE_SCAN",
    "FileScan": "TABLE_SCAN",
    "BatchScan": "TABLE_SCAN",
    "OneRowRelation": "DUMMY_SCAN",
    "LocalTableScan": "CHUNK_SCAN",
    "InMemoryTableScan": "COLUMN_DATA_SCAN",
    "EmptyRelation": "EMPTY_RESULT",
    "Sort": "ORDER_BY",
    "GlobalLimit": "LIMIT",
    "CollectLimit": "LIMIT",
    "LocalLimit": "STREAMING_LIMIT",
    "Sample": "STREAMING_SAMPLE",
    "TakeOrderedAndProject": "TOP_N",
    "Window": "WINDOW",
    "Generate": "UNNEST",
    "HashAggregate": "HASH_GROUP_BY",
    "ObjectHashAggregate": "HASH_GROUP_BY",
    "SortAggregate": "HASH_GROUP_BY",
    "Filter": "FILTER",
    "Project": "PROJECTION",
    "BroadcastHashJoin": "HASH_JOIN",
    "ShuffledHashJoin": "HASH_JOIN",
    "SortMergeJoin": "HASH_JOIN",
    "BroadcastNestedLoopJoin": "NESTED_LOOP_JOIN",
    "CartesianProduct": "CROSS_PRODUCT",
    "Union": "UNION",
    "UnionLoop": "RECURSIVE_CTE",
    "UnionLoopRef": "RECURSIVE_CTE_SCAN",
    "Expand": "EXPRESSION_SCAN",
    "MergeRows": "MERGE_INTO",
    "DeleteFromTable": "DELETE_OPERATOR",
    "AppendData": "INSERT",
    "CreateTable": "CREATE_TABLE",
    "CreateTableAsSelect": "CREATE_TABLE_AS",
    "AtomicCreateTableAsSelect": "CREATE_TABLE_AS",
    "CreateNamespace": "CREATE_SCHEMA",
    "DropTable": "DROP",
    "SetVariable": "SET_VARIABLE",
    "BatchEvalPythonUDTF": "INOUT_FUNCTION",
    "ArrowEvalPythonUDTF": "INOUT_FUNCTION",
    "MapInPandas": "INOUT_FUNCTION",
    "MapInArrow": "INOUT_FUNCTION",
}
#: That of each command that runs by itself.
COMMANDS = {
    "InsertIntoHadoopFsRelationCommand": "COPY_TO_FILE",
    "CreateViewCommand": "CREATE_VIEW",
    "CreateTableCommand": "CREATE_TABLE",
    "CreateDataSourceTableCommand": "CREATE_TABLE",
    "CreateDataSourceTableAsSelectCommand": "CREATE_TABLE_AS",
    "CreateSQLFunctionCommand": "CREATE_MACRO",
    "CreateFunctionCommand": "CREATE_MACRO",
    "DropTableCommand": "DROP",
    "DropTempViewCommand": "DROP",
    "ExplainCommand": "EXPLAIN",
    "SetCommand": "SET",
    "ResetCommand": "RESET",
    "LoadDataCommand": "LOAD",
    "AddJarsCommand": "LOAD",
}
_AGGREGATES = ("HASH_GROUP_BY", "UNGROUPED_AGGREGATE")


def kind_of(name: str, ungrouped: bool = False, local: bool = False, what: str = "") -> str | None:
    """The vocabulary's name of a node; ungrouped: an aggregate without keys; local: a sort within partitions; what: a scan's relation."""
    kind = NODES.get(name) or COMMANDS.get(name) or next((k for c, k in COMMANDS.items() if c in what), None)
    if kind == "HASH_GROUP_BY" and ungrouped:
        return "UNGROUPED_AGGREGATE"
    if kind == "ORDER_BY" and local:
        return None
    if kind == "TABLE_SCAN" and "OneRowRelation" in what:
        return "DUMMY_SCAN"
    return kind


def distribution(plan: Any) -> dict[str, int]:
    """How often each name of the vocabulary occurs in a plan (nodes with kind and children), noughts included.

    Spark aggregates in two steps or more, which count as one operator."""
    out = dict.fromkeys(VOCABULARY, 0)
    out["ROOT"] = out["RESULT_COLLECTOR"] = 1

    def visit(nodes: Iterable[Any], above: str | None) -> None:
        for node in nodes:
            again = node.kind in _AGGREGATES and above in _AGGREGATES
            if node.kind and not again:
                out[node.kind] += 1
            # Exchanges and sorts between the steps have no name; a projection there belongs to them.
            visit(node.children, node.kind if node.kind else above)

    visit([plan], None)
    return out

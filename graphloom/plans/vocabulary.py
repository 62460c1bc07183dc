"""The vocabulary of the graph as plain values; they are fixed, and results depend on them."""

from __future__ import annotations

# Edge types that impact walks follow, by role.
OWNERSHIP = ("CONTAINS", "DEFINES_KEY")
PROPAGATING = (
    "IMPORTS", "CALLS", "IMPLEMENTS", "EXTENDS", "READS_FROM", "WRITES_TO", "PUBLISHES", "SUBSCRIBES_TO", "TRIGGERS", "EXPOSES", "RECORDED_IN", "RELAYS_TO", "DELIVERS_TO",
    "PROJECTS_TO", "SPECIFIED_BY", "IMPLEMENTS_OPERATION", "RENDERS_KEY", "FLOWS_TO", "RENAMED_TO", "SERIALIZED_AS", "DEPENDS_ON",
)
SUPPORTING = ("DEPLOYED_AS", "CONFIGURES", "TESTS", "USES", "INJECTS", "NAVIGATES_TO", "SUBMITS_TO", "CALLS_ENDPOINT", "USES_MIDDLEWARE", "REFERENCES_RESOURCE", "BINDS", "USES_UNKNOWN")
# Followed from target to source only.
UPWARD_ONLY = ("CONTAINS", "DEFINES_KEY", "DEPENDS_ON")
# Of a budget of their own; a hop over one starts the structural depth anew.
CHAIN = (
    "PUBLISHES", "SUBSCRIBES_TO", "TRIGGERS", "DEPLOYED_AS", "EXPOSES", "RECORDED_IN", "RELAYS_TO", "DELIVERS_TO", "PROJECTS_TO", "SPECIFIED_BY", "IMPLEMENTS_OPERATION",
    "RENDERS_KEY", "FLOWS_TO", "RENAMED_TO", "SERIALIZED_AS",
)
# A single hop against the edge is a weak link.
WEAK_REVERSED = ("IMPORTS", "CALLS", "USES", "INJECTS", "NAVIGATES_TO", "SUBMITS_TO", "CALLS_ENDPOINT", "USES_MIDDLEWARE", "REFERENCES_RESOURCE", "BINDS")
NEVER_STRONG = "USES_UNKNOWN"

# How a concept was matched: strength, signal in percent, and the evidence that it gives.
MECHANISM_STRENGTH = {"exact": 2, "alias": 2, "path-suffix": 2, "basename": 1, "name-similarity": 1, "path-segment": 1, "semantic": 1, "lexical": 0}
MECHANISM_SIGNAL = {"exact": 90, "alias": 90, "path-suffix": 90, "basename": 45, "name-similarity": 50, "path-segment": 50, "semantic": 50, "lexical": 50}
CONTAINER_NAME_SIGNAL = 45
MECHANISM_BASIS = {
    "exact": "direct-structural", "alias": "direct-structural", "path-suffix": "direct-structural", "basename": "name-similarity", "name-similarity": "name-similarity",
    "path-segment": "name-similarity", "semantic": "semantic-match", "lexical": "lexical-only",
}
GUESSED = ("path-segment", "name-similarity", "basename", "semantic", "lexical")
CONTAINER_TYPES = ("package", "workspace", "repository", "directory")

# Signals in percent.
EDGE_SIGNAL = {"IMPORTS": 10, "CALLS": 10, "READS_FROM": 10, "WRITES_TO": 10, "PUBLISHES": 5, "SUBSCRIBES_TO": 5, "TESTS": 5, "DEPLOYED_AS": 5}
HOP, AMBIGUITY, TEST_ONLY, CO_CHANGE = -25, -15, -25, 10
LEAST, MOST = 5, 99

# Evidence, strongest first, and the highest likelihood that each allows.
EVIDENCE = {
    "direct-structural": "required", "async-event": "required", "external-contract": "required", "field-data-flow": "required", "configuration-asset": "likely",
    "transitive-structural": "likely", "name-similarity": "likely", "semantic-match": "likely", "lexical-only": "lexical-only",
}
EVIDENCE_RANK = {name: i for i, name in enumerate(EVIDENCE)}
LIKELIHOOD_RANK = {"required": 0, "likely": 1, "possible": 2, "lexical-only": 3, "unlikely": 4, "excluded": 5}
BASIS_EDGES = {
    "async-event": ("PUBLISHES", "SUBSCRIBES_TO", "TRIGGERS", "BINDS", "DELIVERS_TO", "PROJECTS_TO", "RECORDED_IN"),
    "external-contract": ("CALLS_ENDPOINT", "EXPOSES", "SUBMITS_TO", "SPECIFIED_BY", "IMPLEMENTS_OPERATION"),
    "field-data-flow": ("FLOWS_TO", "RENAMED_TO", "SERIALIZED_AS"),
    "configuration-asset": ("CONFIGURES", "DEFINES_KEY", "RENDERS_KEY"),
}
BASIS_NODES = {
    "async-event": ("topic", "queue", "subscription", "publisher", "consumer", "pubsub-topic", "pubsub-subscription", "domain-event", "outbox-record"),
    "external-contract": ("api-endpoint", "external-api", "third-party-service", "webhook", "openapi-document", "openapi-operation", "unresolved-external-boundary"),
    "field-data-flow": ("field",),
    "configuration-asset": ("configuration-file", "locale-bundle", "translation-key", "json-schema", "template", "migration", "environment-variable", "terraform-resource", "terraform-module", "cloud-run-service", "cloud-run-job"),
}

# What an impact is, by node type, else by category, else domain-model.
IMPACT_BY_TYPE = {
    "migration": "migration", "api-endpoint": "api-contract", "controller": "api-contract", "handler": "api-contract", "job": "background-processing", "test": "testing",
    "page": "read-model", "ui-component": "read-model", "form": "read-model", "policy": "business-rule", "invariant": "business-rule", "business-rule": "business-rule",
    "domain-event": "event-contract", "external-api": "integration", "third-party-service": "integration", "deployment-pipeline": "deployment",
}
IMPACT_BY_CATEGORY = {"data": "data-model", "integration": "event-contract", "infrastructure": "infrastructure"}
CONSEQUENCES = ("api-contract", "data-model", "migration", "event-contract", "background-processing", "integration", "security", "infrastructure", "deployment", "business-rule")

# Kinds of change by the first pattern that a statement fits, and what they mean for those who use what changes.
CHANGE_KINDS = (
    ("remove-api", r"\b(remove|delete|drop|rename|replace)[sd]?\b"),
    (
        "change-construction",
        r"\b(constructor|instantiat\w+|construction|composition root|factory (input|argument|parameter)s?|provider registration|register(ed|s)? (the )?(provider|dependency|service))\b",
    ),
    ("change-configuration", r"\b(environment (variable|key)s?|config(uration)? (key|value|setting)s?|provider tokens?|credentials?|connection settings)\b"),
    ("change-api", r"\b(signature|required (argument|parameter)|take (a|an|another)[\w\s-]{0,20}(argument|parameter)|accept (a|an)[\w\s-]{0,20}(argument|parameter))\b"),
    ("change-data-shape", r"\b(payload|schema|response shape|data shape|serial[iz]s?ed?)\b"),
    ("add-api", r"\b(add|introduce|expose|provide|offer)[sd]?\b"),
    ("change-behavior", r"\b(filter|validate|calculate|compute|sort|order|reject|hide|include|exclude)[sd]?\b"),
)
COMPATIBILITY = {
    "remove-api": "breaking", "change-construction": "potentially-breaking", "change-configuration": "potentially-breaking", "change-api": "potentially-breaking",
    "change-data-shape": "potentially-breaking", "add-api": "additive", "change-behavior": "unknown", "unknown": "unknown",
}
NO_CUE = "no explicit change verb"
# Kinds of change that oblige the other side of a weak link, by its edge type; any other edge type is a reference.
OBLIGES = {
    "CALLS": ("change-api", "remove-api", "change-data-shape", "change-construction"),
    "INJECTS": ("change-construction", "change-configuration", "remove-api", "change-api", "change-data-shape"),
}
REFERENCE_OBLIGES = ("remove-api", "change-data-shape")

# Node types whose consumers are not visible where they change.
FAR_REACHING = (
    "topic", "queue", "subscription", "event", "message-broker", "external-api", "contract", "openapi-document", "proto-service", "route", "terraform-resource", "terraform-module", "terraform-local",
    "terraform-output", "terraform-variable", "cloud-run-service", "cloud-run-job", "service-url", "environment-variable", "configuration-file", "database", "table",
)
# Budgets (structural depth, chain hops, expansions) of a change that stays in one place, and of one that doesn't.
BUDGETS = {"contained": (2, 1, 2_000), "distributed": (2, 8, 20_000)}
# So many impacts of a requirement are kept.
MOST_IMPACTS = 100


def case(column: str, values: dict, default: str = "NULL") -> str:
    """SQL that maps a column by a dictionary."""
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in values.items()) + f" ELSE {default} END"


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)

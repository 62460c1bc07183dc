"""How specifications word things, as plain values; they are fixed, and results depend on them."""

from __future__ import annotations

# Roles of sections by their headings; the first that fits.
HEADINGS = (
    ("preservation", r"(?i)\b(explicitly\s+unchanged|(?:must\s+)?remain(?:s)?\s+unchanged|unchanged\s+behaviou?rs?|preserved\s+behaviou?rs?|behaviou?rs?\s+preserved)\b"),
    ("preservation", r"(?i)\b(regression\s+(?:boundar(?:y|ies)|guards?)|backwards?[-\s]?compat(?:ibility|ible)?|no\s+(?:behaviou?r(?:al)?|functional)\s+change)\b"),
    ("non-goals", r"(?i)\b(non[-\s]?goals?|out[-\s]of[-\s]scope|not\s+in\s+scope)\b"),
    ("non-goals", r"(?i)\b(explicitly\s+)?excluded\b"),
    ("acceptance-criteria", r"(?i)\b(acceptance\s+criteri(a|on)|definition\s+of\s+done|success\s+criteria)\b"),
    ("tasks", r"(?i)\b(tasks?|work\s?items?|to\s?do|subtasks?|checklist)\b"),
    ("open-questions", r"(?i)\b(open\s+questions?|questions?|unknowns?|to\s+clarify)\b"),
    ("implementation-notes", r"(?i)\b(implementation\s+notes?|notes?\s+for\s+implement|technical\s+notes?|hints?)\b"),
    ("constraints", r"(?i)\b(constraints?|limitations?|assumptions?|invariants?)\b"),
    ("context", r"(?i)\b(context|background|motivation|why|problem\s+statement|intro)\b"),
    ("decisions", r"(?i)\b(decisions?|design|approach|architecture\s+notes?)\b"),
    ("goals", r"(?i)\b(goals?|objectives?|scope)\b"),
    ("requirements", r"(?i)\b(requirements?|behaviou?rs?|what\s+to\s+(build|change|implement)|changes?)\b"),
)
REQUIRING = ("requirements", "acceptance-criteria", "tasks", "preservation")
# What the statements of other sections are; constraints and questions are kinds of their own.
NOTED = {"context": "context", "goals": "context", "implementation-notes": "implementation-note", "decisions": "implementation-note", "non-goals": "non-goal"}
# Prose of these sections is never admitted, or only where it is strongly normative.
CLOSED = ("non-goals", "open-questions", "constraints")
STRICT = ("context", "implementation-notes", "decisions")

# Lines.
ATX = r"^(#{1,6})\s+(.*\S)\s*$"
UNDERLINE = r"^(=+|-{3,})\s*$"
LIST_MARKER = r"^([-*+•–—]\s|\d{1,3}[.)]\s)"
EMPHASIS_ONLY = r"^(\*{1,2}|_{1,2})([^*_]+?)\1:?$"
COLON_HEADING = r"^[A-Z][^:]{0,47}:$"
PSEUDO_LEVEL, PSEUDO_CHARS, PSEUDO_WORDS = 3, 60, 6
FENCE = r"^\s*(```|~~~)"
LABEL = r"^\**((?:[A-Z]{1,4})[-\s]?\d{1,3}(?:\.\d{1,2})?)\**\s*[:.)\]–—-]\s+(?=\S)"
#: The same for authors who number past 999.
LONG_LABEL = LABEL.replace(r"\d{1,3}(?:", r"\d+(?:")
NUMBERED = r"^(\d{1,3})[.)]\s+(?=\S)"
TASK = r"^[-*+]\s+\[[ xX]\]\s+(?=\S)"
BULLET = r"^[-*+•–—]\s+(?=\S)"
PROSE_BULLET = r"^([-*+]|\d+[.)])\s+"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z`\"'(\[])"
ORIGINS = {"requirements": "bullet-item", "acceptance-criteria": "acceptance-criterion", "tasks": "task-item"}
LEAST_ITEM, LEAST_STATEMENT = 3, 12

# Sentences.
STRONG_MODAL = r"(?i)\b(must|shall|should|needs?\s+to|(?:is|are)\s+required\s+to|ha(?:s|ve)\s+to)\b"
WILL = r"(?i)\bwill\b"
IMPERATIVE = (
    "add", "implement", "change", "rename", "remove", "support", "cap", "resolve", "emit", "return", "report", "create", "introduce", "expose", "update", "delete", "replace", "extend", "migrate", "move",
    "split", "extract", "validate", "reject", "allow", "block", "log", "record", "store", "persist", "ensure", "prevent", "stop", "wire", "surface",
)
DEMOTING = (
    r"(?i)\b(currently|today|previously|historically|so\s+far|until\s+now|at\s+the\s+moment|right\s+now|in\s+the\s+past|used\s+to)\b",
    r"(?i)\b(because|since|as\s+a\s+result|therefore|for\s+example|for\s+instance)\b|\be\.g\.|\bi\.e\.",
    r"(?i)\b(was|were|had\s+been|has\s+been|have\s+been|introduced|caused|led\s+to|resulted\s+in)\b",
    r"(?i)\b(this\s+(document|doc|spec|specification|section|page)|the\s+following\s+sections?)\b",
)
VAGUE = r"(?i)\b(must|should|shall|will|needs? to|require)\b"
_SAME = "unchanged|untouched|as-is|as is|intact|the same"
GUARDS = (
    r"(?i)\b(?:must|shall|should|may|will|can)\s+(?:not|never)\s+(?:\w+\s+){0,2}?(?:change|be\s+(?:changed|affected|modified|touched|altered|impacted|broken)|break|regress)\b",
    rf"(?i)\b(?:remain|remains|stay|stays|continue|continues)\s+(?:to\s+be\s+)?(?:{_SAME})\b",
    r"(?i)\b(?:must|shall|should|will)\s+(?:continue|keep)\s+(?:to\s+\w+|\w+ing)\b",
    r"(?i)\bno\s+(?:behaviou?r(?:al)?|functional|semantic|observable)\s+(?:change|changes|difference|differences)\b",
    r"(?i)\bno\s+(?:change|changes)\s+(?:in|to)\s+(?:the\s+)?(?:behaviou?r|semantics|output)\b",
    r"(?i)\bexisting\s+[\w\s.`'-]{0,40}?(?:continues?\s+to\s+\w+|(?:is|are)\s+(?:preserved|unaffected|untouched)|remains?\s+(?:unchanged|as-is|intact)|stays?\s+(?:unchanged|as-is|intact))\b",
    r"(?i)\b(?:nothing|no\s+other\s+\w+)\s+(?:else\s+)?(?:should|must|shall|will|may)\s+(?:change|be\s+(?:changed|affected|modified|touched))\b",
    r"(?i)\b(?:preserve|preserving)\s+(?:the\s+)?(?:existing|current)\b",
    r"(?i)\bbackwards?[-\s]?compatib(?:le|ility)\b",
)
BOUNDLESS = r"(?i)\b(?:nothing|anything|everything)\b|\b(?:all|any|no)\s+(?:other|remaining)\b|\bthe\s+rest\b|\b(?:any|every|some)where\s+else\b"
CONFIDENCE = {"guard": 0.8, "modal": 0.8, "imperative": 0.65, "will": 0.55}
PROVISIONAL_OVER = 3

# What statements say of the things they name: that they come into being, that they lie outside, of which kind they are.
CREATION = r"(?i)\b(add|adds|adding|new|create|creates|creating|introduce|introduces|support for|index|model|models|modelled|emit|emits|expose|exposes|record|records|classify|classifies|derive|derives|represent|represents|extract|extracts|validate|validates)\b"
OUTSIDE = r"(?i)\b(third[- ]party|external (?:service|system|api)|vendor|upstream provider|sendgrid|stripe|twilio)\b"
SURFACES = (
    (r"(?i)\b(localization|localisation|i18n|translation|locale)\b", ("locale-bundle", "translation-key")),
    (r"(?i)\b(route|endpoint|path)\b", ("api-endpoint", "controller", "handler")),
    (r"(?i)\b(schema|contract)\b", ("json-schema", "openapi-document", "schema")),
    (r"(?i)\b(migration)\b", ("migration",)),
    (r"(?i)\b(feature flag)\b", ("feature-flag",)),
    (r"(?i)\b(event|topic|queue)\b", ("topic", "pubsub-topic", "domain-event")),
)
READINGS = {"coverage-gap": 80, "external-dependency": 70, "new-surface": 70, "terminology-mismatch": 60, "insufficient-evidence": 30}
OPEN_READINGS = ("new-surface", "external-dependency", "coverage-gap", "terminology-mismatch")
MOST_NEAREST = 5

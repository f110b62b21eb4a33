"""The compiled form of a schema: what readers, writers and templates work on. Plain data, shipped to workers as it is."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from xmlframe.functions.facets import Facets
from xmlframe.functions.types import Builtin


@dataclass(eq=False)
class Simple:
    name: str
    variety: str = "atomic"  # atomic, list, union
    builtin: Builtin | None = None
    steps: list[Facets] = field(default_factory=list)  # of the restrictions, outermost base first
    item: Simple | None = None
    members: list[Simple] = field(default_factory=list)
    blocked: bool = False


@dataclass(eq=False)
class Wildcard:
    """Namespaces that may appear: those in ``yes`` (None: all) but those in ``no``."""

    yes: tuple[str, ...] | None = None
    no: tuple[str, ...] = ()
    process: str = "strict"

    def admits(self, ns: str) -> bool:
        return (self.yes is None or ns in self.yes) and ns not in self.no


@dataclass(eq=False)
class Attribute:
    key: str
    ns: str
    local: str
    type: Simple
    use: str = "optional"
    default: str | None = None
    fixed: str | None = None


@dataclass(eq=False)
class Element:
    key: str
    ns: str
    local: str
    type: Simple | Complex
    nillable: bool = False
    default: str | None = None
    fixed: str | None = None
    abstract: bool = False
    members: list[Element] = field(default_factory=list)  # elements that may stand for it; with any, it is a head
    xsi: dict[str, Simple | Complex] = field(default_factory=dict)
    blocked: bool = False
    path: str = ""
    id: str | None = None


@dataclass(eq=False)
class Group:
    kind: str  # sequence, choice, all
    particles: list[Particle] = field(default_factory=list)


@dataclass(eq=False)
class Particle:
    term: Element | Group | Wildcard
    min: int = 1
    max: int | None = 1
    label: str = ""  # key of a repeated block

    @property
    def many(self) -> bool:
        return self.max is None or self.max > 1


@dataclass(eq=False)
class Complex:
    name: str
    content: Particle | None = None
    simple: Simple | None = None
    attributes: list[Attribute] = field(default_factory=list)
    any_attribute: Wildcard | None = None
    mixed: bool = False
    abstract: bool = False
    any_type: bool = False


@dataclass
class Hook:
    """What to run at elements that any selector meets (no selector: at all of them)."""

    before: list[Callable | str] = field(default_factory=list)
    replace: Callable | str | None = None
    after: list[Callable | str] = field(default_factory=list)
    action: str | None = None  # READER or WRITER
    path: object = None
    type: object = None
    id: object = None
    extends: str | None = None


@dataclass
class Options:
    """Compile options; see the README for what each does."""

    validation: bool | None = None
    check_values: bool = True
    check_occurs: bool = True
    ignore_facets: bool = False
    elements_qualified: str | bool | None = None
    attributes_qualified: str | bool | None = None
    prefixes: dict[str, str] = field(default_factory=dict)  # prefix: namespace
    include_namespaces: bool | Callable[[str, str], bool] = True
    use_default_namespace: bool = False
    sloppy_integers: bool = False
    sloppy_floats: bool = False
    big_numbers: str = "error"  # numbers without bounds that DECIMAL can't hold: a violation, or string: all of them as texts
    any_element: str | Callable = "SKIP_ALL"
    any_attribute: str | Callable = "SKIP_ALL"
    any_type: Callable | None = None
    hooks: list[Hook] = field(default_factory=list)
    permit_href: bool = False
    ignore_unused_tags: bool | str = False
    interpret_nillable_as_optional: bool = False
    typemap: dict[str, object] = field(default_factory=dict)
    mixed_elements: str | Callable = "ATTRIBUTES"
    key_rewrite: list = field(default_factory=list)
    default_values: str | None = None  # EXTEND, IGNORE, MINIMAL
    abstract_types: str = "ERROR"
    block_namespace: list = field(default_factory=list)
    xsi_type: dict[str, list[str] | str] = field(default_factory=dict)
    xsi_type_everywhere: bool = False
    date_facets: str = "lexical"
    nil_mode: str = "flag"  # flag, null, string
    cdata: tuple[str, ...] | list[str] = ()  # paths of simple elements that are written as CDATA
    path: str | None = None  # what paths in violations begin with, in place of the root's name
    order_check: bool | str = True  # or python: in document order, with the exact message

    def __post_init__(self) -> None:
        if self.validation is not None:
            self.check_values = self.check_occurs = bool(self.validation)
            self.ignore_facets = not self.validation

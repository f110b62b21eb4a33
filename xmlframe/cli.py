"""Command line: XML to JSON or YAML by a schema, and examples of a schema's element.

    python -m xmlframe.cli xml2json message.xml schema.xsd [--type {ns}name] [--root off]
    python -m xmlframe.cli xml2yaml message.xml schema.xsd
    python -m xmlframe.cli schema2example schema.xsd --type {ns}name [--output XML]
"""

from __future__ import annotations

import argparse
import base64
import json
import sys

from xmlframe.engine import XmlSchema
from xmlframe.sources.xml import load


def jsonable(x):
    if isinstance(x, (bytes, bytearray)):
        return base64.b64encode(x).decode()
    if isinstance(x, float) and x != x:
        return "NaN"
    return int(x) if hasattr(x, "as_tuple") and x == x.to_integral_value() else float(x)


def yaml(x, pad: str = "") -> str:
    """Data of nested dictionaries, lists and scalars as YAML."""
    if isinstance(x, dict) and x:
        return "".join(f"{pad}{k}:" + (f"\n{yaml(v, pad + '  ')}" if isinstance(v, (dict, list)) and v else f" {yaml(v).strip()}\n") for k, v in x.items())
    if isinstance(x, list) and x:
        return "".join(f"{pad}- {yaml(v, pad + '  ').lstrip()}" for v in x)
    return pad + json.dumps(x, ensure_ascii=False, default=jsonable) + "\n"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="xmlframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    own = parser.add_subparsers(dest="command", required=True)
    for name in ("xml2json", "xml2yaml"):
        p = own.add_parser(name)
        p.add_argument("message")
        p.add_argument("schemas", nargs="+")
        p.add_argument("--type")
        p.add_argument("--root", choices=("on", "off"), default="on", help="keep the root element's name")
        p.add_argument("--mixed", default="TEXTUAL")
        p.add_argument("--exact", action="store_true", help="exact integers and decimals instead of native numbers")
    p = own.add_parser("schema2example")
    p.add_argument("schemas", nargs="+")
    p.add_argument("--type", required=True)
    p.add_argument("--output", choices=("DATA", "XML", "TREE"), default="DATA")
    p.add_argument("--show", default="ALL", help="comments: ALL, NONE, or some of type,occur,facets,struct")
    a = parser.parse_args(argv)
    schema = XmlSchema(a.schemas)
    if a.command == "schema2example":
        print(schema.template(a.output, a.type, comments=a.show))
        return 0
    node = load(sys.stdin) if a.message == "-" else load(a.message)
    name = a.type or node.name
    data = schema.reader(name, sloppy_integers=not a.exact, sloppy_floats=not a.exact, mixed_elements=a.mixed).read(node)
    data = {node.local: data} if a.root == "on" else data
    print(yaml(data) if a.command == "xml2yaml" else json.dumps(data, ensure_ascii=False, indent=2, default=jsonable))
    return 0


if __name__ == "__main__":
    sys.exit(main())

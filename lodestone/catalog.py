"""Parsers of catalog documents: the automatic one and one for each version."""

from functools import partial

from lodestone.functions.detect import LATEST, parse as _parse, parse_version as _parse_version

KIND = "catalog"
LATEST_VERSION = LATEST[KIND]
parse = partial(_parse, kind=KIND)
parse_v1 = partial(_parse_version, kind=KIND, version=1)

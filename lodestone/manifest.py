"""Parsers of manifest documents: the automatic one and one for each version."""

from functools import partial

from lodestone.functions.detect import LATEST, parse as _parse, parse_version as _parse_version

KIND = "manifest"
LATEST_VERSION = LATEST[KIND]
parse = partial(_parse, kind=KIND)
parse_v1 = partial(_parse_version, kind=KIND, version=1)
parse_v2 = partial(_parse_version, kind=KIND, version=2)
parse_v3 = partial(_parse_version, kind=KIND, version=3)
parse_v4 = partial(_parse_version, kind=KIND, version=4)
parse_v5 = partial(_parse_version, kind=KIND, version=5)
parse_v6 = partial(_parse_version, kind=KIND, version=6)
parse_v7 = partial(_parse_version, kind=KIND, version=7)
parse_v8 = partial(_parse_version, kind=KIND, version=8)
parse_v9 = partial(_parse_version, kind=KIND, version=9)
parse_v10 = partial(_parse_version, kind=KIND, version=10)
parse_v11 = partial(_parse_version, kind=KIND, version=11)
parse_v12 = partial(_parse_version, kind=KIND, version=12)

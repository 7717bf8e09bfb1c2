"""A change feed out of a file of lines (ms, id, body), for tests: what is in the file is what the feed shows."""

import json
from pathlib import Path


class FileFeed:
    def __init__(self, options):
        path = Path(options["path"])
        self.rows = sorted(tuple(json.loads(x)) for x in path.read_text().splitlines()) if path.exists() else []

    def page(self, since, limit):
        return [r for r in self.rows if r[0] >= since][:limit]

    def newest(self):
        return self.rows[-1][0] if self.rows else None

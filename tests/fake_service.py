"""Clients of the HTTP server that test_services runs; Spark's tasks import them by name."""

import json
import urllib.error
import urllib.parse
import urllib.request


class Client:
    def __init__(self, options):
        self.url, self.counts = options["url"], options.get("counts", "yes") == "yes"

    def _get(self, path, **query):
        with urllib.request.urlopen(f"{self.url}/{path}?{urllib.parse.urlencode(query)}", timeout=20) as answer:
            return json.loads(answer.read())

    def page(self, offset, size):
        return self._get("page", offset=offset, size=size)

    def total(self):
        return self._get("total")["total"] if self.counts else None

    def search(self, channel, start, end):
        with urllib.request.urlopen(f"{self.url}/search?channel={channel}&at={start.timestamp()}", timeout=20) as answer:
            return answer.read()

    def size(self, url):
        return self._get("size", of=url)["size"]

    def read(self, url, offset):
        request = urllib.request.Request(f"{self.url}/file?of={url}", headers={"Range": f"bytes={offset}-"})
        with urllib.request.urlopen(request, timeout=20) as answer:
            while chunk := answer.read1(1000):
                yield chunk

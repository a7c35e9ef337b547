"""A language server over framed JSON messages.

One message at a time, in order. Open buffers shadow files; after each change
the project is checked as a whole and every open file gets its diagnostics,
empty lists included. A message that fails is answered with an error and does
not end the session.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any, BinaryIO

from pyspark.sql import DataFrame, SparkSession

from ..functions.editor import identifier_span, path_of, uri_of
from ..functions.positions import LineMap, byte_to_utf16, utf16_to_byte
from ..functions.rpc import read_message, write_message
from ..operators import editor
from ..plans import projects
from ..sources.files import Config, ConfigError, discover, find_config, from_texts, load_config

#: Fixed values of the protocol.
METHOD_NOT_FOUND, INTERNAL_ERROR, INVALID_REQUEST = -32601, -32603, -32600
CLASS_ITEM, STRUCT_ITEM = 7, 22
_LABELS = {"alter_table": "table", "other": "object"}


class LanguageServer:
    """Serves definition, hover, completion, diagnostics and dependency graphs."""

    def __init__(self, spark: SparkSession, source: BinaryIO, sink: BinaryIO):
        self.spark, self.source, self.sink = spark, source, sink
        self.buffers: dict[str, str] = {}
        self.warned: set[str] = set()
        self.stopping = False
        self.requests: dict[str, Callable[[dict], Any]] = {
            "initialize": self._initialize,
            "shutdown": self._shutdown,
            "textDocument/definition": self._definition,
            "textDocument/hover": self._hover,
            "textDocument/completion": self._completion,
        }
        self.notices: dict[str, Callable[[dict], None]] = {
            "textDocument/didOpen": lambda p: self._changed(p, p["textDocument"]["text"]),
            "textDocument/didChange": self._did_change,
            "textDocument/didClose": self._did_close,
        }

    def serve(self) -> int:
        """Until ``exit`` or the end of the stream; 0 only after ``shutdown``."""
        while True:
            try:
                message = read_message(self.source)
            except (json.JSONDecodeError, UnicodeDecodeError) as e:  # a bad body must not end the session
                print(f"message that is no JSON: {e}", file=sys.stderr)
                continue
            if message is None:
                break
            if not isinstance(message, dict) or not isinstance(message.get("method", ""), str):
                print("message that is no request", file=sys.stderr)
                continue
            method = message.get("method", "")
            if method == "exit":
                break
            if "id" in message:
                self._answer(message, method)
            elif method in self.notices:
                try:
                    self.notices[method](message.get("params") or {})
                except Exception as e:
                    print(f"{method}: {e}", file=sys.stderr)
        return 0 if self.stopping else 1

    def _answer(self, message: dict, method: str) -> None:
        handler = self._graph if method.endswith("/dependencyGraph") else self.requests.get(method)
        out: dict[str, Any] = {"jsonrpc": "2.0", "id": message["id"]}
        try:
            if handler is None:
                out["error"] = {"code": METHOD_NOT_FOUND, "message": f"method not found: {method}"}
            else:
                out["result"] = handler(message.get("params") or {})
        except (KeyError, TypeError):
            out["error"] = {"code": INVALID_REQUEST, "message": "invalid params"}
        except Exception as e:
            out["error"] = {"code": INTERNAL_ERROR, "message": f"internal error: {e}"}
        write_message(self.sink, out)

    def _initialize(self, params: dict) -> dict:
        offers = {
            "textDocumentSync": {"openClose": True, "change": 1}, "definitionProvider": True, "hoverProvider": True,
            "completionProvider": {}, "positionEncoding": "utf-16", "experimental": {"dependencyGraph": True},
        }
        return {"capabilities": offers, "serverInfo": {"name": "lineagrid"}}

    def _shutdown(self, params: dict) -> dict:
        self.stopping = True
        return {}

    # Projects and texts.

    def _project(self, path: str) -> tuple[Config, Path] | None:
        """The configuration that owns a file: it names a dialect and the file lies under its root."""
        try:
            config = load_config(find_config(Path(path).parent))
            root = Path(config.schema_dir or config.path.parent).resolve()
            if config.dialect and Path(path).resolve().is_relative_to(root):
                return config, root
            reason = "no dialect" if not config.dialect else "outside the schema folder"
        except (ConfigError, FileNotFoundError) as e:
            reason = str(e)
        if path not in self.warned:
            self.warned.add(path)
            print(f"{path}: {reason}", file=sys.stderr)
        return None

    def _text(self, path: str) -> str:
        held = self.buffers.get(path)
        return (Path(path).read_bytes().decode("utf-8", "replace") if held is None else held).replace("\r\n", "\n")

    def _files(self, config: Config, root: Path) -> DataFrame:
        return from_texts(self.spark, {f: self._text(str(root / f)) for f in discover(root)}, config.dialect)

    # Notifications.

    def _did_change(self, params: dict) -> None:
        if params["contentChanges"]:
            self._changed(params, params["contentChanges"][-1]["text"])

    def _changed(self, params: dict, text: str) -> None:
        uri = params["textDocument"]["uri"]
        self.buffers[path_of(uri)] = text
        self._publish(path_of(uri), uri)

    def _did_close(self, params: dict) -> None:
        uri = params["textDocument"]["uri"]
        self.buffers.pop(path_of(uri), None)
        self._send(uri, [])
        self._publish(path_of(uri), None)

    def _send(self, uri: str, found: list[dict]) -> None:
        body = {"uri": uri, "diagnostics": found}
        write_message(self.sink, {"jsonrpc": "2.0", "method": "textDocument/publishDiagnostics", "params": body})

    def _publish(self, path: str, uri: str | None) -> None:
        owner = self._project(path)
        if owner is None:
            if uri:
                self._send(uri, [])
            return
        config, root = owner
        by_file: dict[str, list[dict]] = {p: [] for p in self.buffers if Path(p).resolve().is_relative_to(root)}
        for row in projects.check(self._files(config, root)).collect():
            own = str(root / row["file"])
            if own in by_file:
                place = self._range(self._text(own), row["line"], row["col"])
                severity = 1 if row["severity"] == "error" else 2
                by_file[own].append({"range": place, "severity": severity, "message": row["message"], "source": "lineagrid"})
        for own, found in by_file.items():
            self._send(uri_of(own), found)

    # Requests.

    @staticmethod
    def _range(text: str, line: int, col: int) -> dict:
        """The identifier at a 1-based line and byte column, in UTF-16 units."""
        view = text.encode().decode("latin-1")
        lines = LineMap(view)
        start = lines.offset(line, col)
        _, stop = identifier_span(view, start)
        first = lines.starts[min(line, len(lines.starts)) - 1]
        own = view[first:].split("\n", 1)[0].encode("latin-1")
        units = [{"line": line - 1, "character": byte_to_utf16(own, at - first)} for at in (start, stop)]
        return {"start": units[0], "end": units[1]}

    def _asked(self, params: dict) -> tuple[DataFrame, DataFrame, Path, str, int] | None:
        """The request as a row, the project's files, its root, the text and the byte offset."""
        path, place = path_of(params["textDocument"]["uri"]), params["position"]
        owner = self._project(path)
        if owner is None:
            return None
        text = self._text(path)
        view = text.encode()
        lines = LineMap(view.decode("latin-1"))
        first = lines.offset(place["line"] + 1, 1)
        offset = first + utf16_to_byte(view[first:].split(b"\n", 1)[0], place["character"])
        file = Path(path).resolve().relative_to(owner[1]).as_posix()
        row = self.spark.createDataFrame([("r", "", file, offset)], "request string, project string, file string, offset int")
        return row, self._files(*owner), owner[1], text, offset

    def _definition(self, params: dict) -> dict | None:
        asked = self._asked(params)
        if asked is None:
            return None
        row, files, root, _, _ = asked
        found = editor.definition_of(row, projects.parse(files), files).first()
        if found is None:
            return None
        path = str(root / found["file"])
        return {"uri": uri_of(path), "range": self._range(self._text(path), found["line"], found["col"])}

    def _hover(self, params: dict) -> dict | None:
        asked = self._asked(params)
        if asked is None:
            return None
        row, files, _, text, offset = asked
        found = editor.hover(row, projects.parse(files), files).first()
        if found is None:
            return None
        line, col = LineMap(text.encode().decode("latin-1")).locate(offset)
        value = f"```sql\n{found['shown']}\n```\ndefined in {found['file']}"
        return {"contents": {"kind": "markdown", "value": value}, "range": self._range(text, line, col)}

    def _completion(self, params: dict) -> dict:
        asked = self._asked(params)
        items = []
        if asked is not None:
            row, files, _, _, _ = asked
            for r in editor.completions(row, projects.parse(files), files).collect():
                label = _LABELS.get(r["kind"], r["kind"].removeprefix("create_"))
                kind = STRUCT_ITEM if label == "view" else CLASS_ITEM
                detail = f"{label} — {r['file'].rsplit('/', 1)[-1]}"
                items.append({"label": r["label"], "kind": kind, "detail": detail, "insertText": r["label"], "filterText": r["label"]})
        return {"isIncomplete": False, "items": items}

    def _graph(self, params: dict) -> Any:
        owner = self._project(path_of(params["uri"]))
        if owner is None:
            return None
        return json.loads(projects.graph(self._files(*owner), "json"))


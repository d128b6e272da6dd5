"""What can be wrong with a book. `kind` tells the classes apart; none is a special case of another."""

from __future__ import annotations

#: archive: container bytes. resource: a reference or a read. package: the package documents.
#: security: input that must be refused. limit: a bound was passed. content: a content document.
KINDS = ("asset", "archive", "resource", "package", "security", "limit", "content")


class BookError(Exception):
    def __init__(self, kind: str, message: str, path: str | None = None):
        super().__init__(message)
        assert kind in KINDS, kind
        self.kind, self.message, self.path = kind, message, path

    def as_row(self) -> dict:
        return {"kind": self.kind, "message": self.message, "path": self.path}


#: The Spark type of an error column.
ERROR = "struct<kind:string,message:string,path:string>"

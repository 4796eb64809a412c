"""Errors of requests: a stable code, what happened, what to do, and the status of an HTTP answer."""

from __future__ import annotations

#: code: (status, message, suggestion)
CATALOGUE = {
    "QUERY_EMPTY": (400, "the query is empty", "say what to look for, such as 'database connection handling'"),
    "QUERY_TOO_LONG": (400, "the query is too long", "a short description finds more"),
    "INVALID_JSON": (400, "the request isn't valid JSON", "check quotes and commas"),
    "INVALID_REQUEST": (400, "the request can't be answered as it is", "see the documented fields"),
    "NOT_FOUND": (404, "there is no such resource", "see the documented paths"),
    "METHOD_NOT_ALLOWED": (405, "the resource doesn't take this method", "see the documented paths"),
    "NOT_INDEXED": (409, "nothing is indexed yet", "index the tree first"),
    "PROJECT_NOT_INITIALIZED": (409, "there is no project here", "run init in its root"),
    "PROJECT_ALREADY_INITIALIZED": (409, "the project is there already", "its status says more"),
    "INVALID_PROJECT_ROOT": (400, "the project's root isn't a directory", "give another one"),
    "INDEXING_IN_PROGRESS": (409, "the tree is being indexed", "its status says how far"),
    "NO_FILES_TO_INDEX": (422, "no file passes the patterns", "check include, exclude and ignore rules"),
    "CONFIG_INVALID": (422, "the configuration isn't valid", "the details name the settings"),
    "CONFIG_NOT_FOUND": (404, "there is no configuration file", "run init to write one"),
    "EMBEDDER_UNAVAILABLE": (503, "the embedding service doesn't answer", "check that it runs and its address"),
    "EMBEDDER_TIMEOUT": (504, "the embedding service took too long", "try again once its model is loaded"),
    "EMBEDDING_FAILED": (502, "texts couldn't be embedded", "try again; the details say more"),
    "INDEX_UNAVAILABLE": (503, "the index can't be read", "check its folder and permissions"),
    "INDEX_CORRUPTED": (500, "the index is damaged", "index the tree anew"),
    "SEARCH_FAILED": (500, "the search failed", "the details say more"),
    "TIMEOUT": (504, "the request took too long", "ask for less or allow more time"),
    "INTERNAL": (500, "something went wrong", "the details say more"),
}


class RequestError(ValueError):
    """A request that can't be answered, with a code of the catalogue."""

    def __init__(self, code: str, details: str = ""):
        self.code, self.details = code, details
        self.status, self.message, self.suggestion = CATALOGUE[code]
        super().__init__(f"{code}: {details or self.message}")

    def as_dict(self) -> dict[str, str]:
        out = {"code": self.code, "message": self.message, "suggestion": self.suggestion}
        return out | ({"details": self.details} if self.details else {})

"""What a query can be refused for, with the fields a caller needs to answer."""

from __future__ import annotations


class QueryError(Exception):
    code, status = "query_error", 400

    def fields(self) -> dict:
        return {}


class InvalidRequest(QueryError, ValueError):
    code, status = "invalid_request", 422


class ParseError(QueryError, ValueError):
    code, status = "parse", 400


class ExpressionAbsent(QueryError):
    """The selected book lacks terms of the expression."""

    code, status = "expression_absent", 404

    def __init__(self, book_id: int, terms: list[str]) -> None:
        self.book_id, self.terms = book_id, sorted(terms)
        super().__init__(f"book {book_id} lacks {', '.join(self.terms)}")

    def fields(self) -> dict:
        return {"book_id": self.book_id, "terms": self.terms}


class QueryInTooFewBooks(QueryError):
    code, status = "query_in_too_few_books", 404

    def __init__(self, book_id: int | None) -> None:
        self.book_id = book_id
        super().__init__("too few of the requested books carry the whole expression")

    def fields(self) -> dict:
        return {"book_id": self.book_id}


# How the message to a caller ends.
SUGGESTION, NO_SUGGESTION = "Did you mean: {}?", "No similar terms in vocabulary."


class TermResolutionError(QueryError):
    code, status = "term_resolution", 404

    def __init__(self, term: str, candidates: list[str]) -> None:
        self.term, self.candidates = term, candidates
        end = SUGGESTION.format(", ".join(candidates)) if candidates else NO_SUGGESTION
        super().__init__(f"'{term}' is not in the vocabulary. {end}")

    def fields(self) -> dict:
        return {"message": str(self), "term": self.term, "candidates": self.candidates}

"""Errors with the status class a client sees: 400 bad command, 401/403 not allowed, 404 unknown, 409 exists, 500."""


class CommandError(Exception):
    def __init__(self, message: str, status: int = 400):
        super().__init__(message)
        self.status = status


class ParseError(CommandError):
    pass

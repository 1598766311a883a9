"""Typed errors of the public functions. Codes are stable."""


class PostlakeError(Exception):
    code = "internal_error"

    def as_dict(self) -> dict[str, str]:
        return {"error": self.code, "message": str(self)}


class InvalidArgument(PostlakeError, ValueError):
    code = "invalid_argument"


class InvalidOutputPath(InvalidArgument):
    code = "invalid_output_path"


class NotFound(PostlakeError):
    code = "not_found"


class MultipleMatches(PostlakeError):
    code = "multiple_matches"


class HandleSuperseded(PostlakeError):
    code = "handle_superseded"


class ReadOnly(PostlakeError):
    code = "read_only_mode"


class BatchTooLarge(PostlakeError):
    code = "batch_limit_exceeded"


class ConfirmationRequired(PostlakeError):
    code = "confirmation_required"


class ConfirmationStale(PostlakeError):
    code = "confirmation_stale"


class MailNotRunning(PostlakeError):
    code = "mail_not_running"


class AutomationDenied(PostlakeError):
    code = "automation_permission_denied"


class AccessDenied(PostlakeError):
    code = "full_disk_access_denied"


class TimedOut(PostlakeError):
    code = "timeout"


class UndoFailed(PostlakeError):
    code = "undo_failed"


class ExecutionFailed(PostlakeError):
    code = "jxa_execution_error"

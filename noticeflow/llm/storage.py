"""Tables in the shared folder; see ``noticeflow.storage``."""

from noticeflow.storage import drop, new_path, shared_dir, written

__all__ = ["drop", "new_path", "shared_dir", "written"]

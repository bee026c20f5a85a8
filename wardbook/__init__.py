"""Clinical-record, voice-log and laboratory analytics as Spark jobs.

Every public function takes and returns Spark ``DataFrame`` or ``Column``
objects and stays lazy unless its name says that it writes.
"""

"""DataFrame -> DataFrame operators over pages, cues, jobs and artifacts."""

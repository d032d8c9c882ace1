"""Jobs: operators put together the way an archive is run."""

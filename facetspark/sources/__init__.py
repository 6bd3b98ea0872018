"""Where clouds and projects come from and go to."""

from pixelloom.sources.files import frame_directories, image_files, media_files  # noqa: F401
from pixelloom.sources.video import VideoFrameSource, register, video_tables  # noqa: F401

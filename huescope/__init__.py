"""A PySpark analytics engine for camera-frame evidence."""
